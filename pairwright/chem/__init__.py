"""pairwright chem."""
