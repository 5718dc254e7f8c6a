"""pairwright: Spark-native pair mining, QA building and scoring over labelled records."""
