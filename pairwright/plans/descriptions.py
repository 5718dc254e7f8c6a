"""Endpoint descriptions: a dimension table and its cascade of lookups. The texts are our own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import str_or_empty

#: Assays of the Tox21 panel, matched as written.
TOX21 = {
    "NR-AR": "the androgen receptor", "NR-AR-LBD": "the ligand-binding domain of the androgen receptor", "NR-AhR": "the aryl hydrocarbon receptor", "NR-Aromatase": "the enzyme aromatase", "NR-ER": "the estrogen receptor alpha",
    "NR-ER-LBD": "the ligand-binding domain of the estrogen receptor alpha", "NR-PPAR-gamma": "the receptor PPAR-gamma", "SR-ARE": "the antioxidant response element", "SR-ATAD5": "the DNA damage marker ATAD5",
    "SR-HSE": "the heat shock response element", "SR-MMP": "the mitochondrial membrane potential", "SR-p53": "the p53 stress response",
}
#: Organ classes of side effects; the gate ignores case, the lookup does not.
SIDER = (
    "Blood and lymphatic system disorders", "Cardiac disorders", "Congenital, familial and genetic disorders", "Ear and labyrinth disorders", "Eye disorders", "General disorders and administration site conditions",
    "Hepatobiliary disorders", "Immune system disorders", "Infections and infestations", "Injury, poisoning and procedural complications", "Investigations", "Metabolism and nutrition disorders",
    "Musculoskeletal and connective tissue disorders", "Neoplasms benign, malignant and unspecified (incl cysts and polyps)", "Nervous system disorders", "Pregnancy, puerperium and perinatal conditions", "Product issues",
    "Psychiatric disorders", "Renal and urinary disorders", "Reproductive system and breast disorders", "Respiratory, thoracic and mediastinal disorders", "Skin and subcutaneous tissue disorders", "Social circumstances",
    "Surgical and medical procedures", "Vascular disorders",
)
#: Names that stand for an effect of their own, as an endpoint or as a dataset, in lower case.
EFFECTS = {
    "herg_unified": "blockade of the cardiac hERG channel", "ames": "mutations in the Ames bacterial assay", "clintox": "toxicity that ended clinical trials", "dilist": "liver injury in humans",
    "cyp1a2_veith": "inhibition of the enzyme CYP1A2", "cyp2c19_veith": "inhibition of the enzyme CYP2C19", "cyp2c9_veith": "inhibition of the enzyme CYP2C9", "cyp2d6_veith": "inhibition of the enzyme CYP2D6", "cyp3a4_veith": "inhibition of the enzyme CYP3A4",
    "dictrank": "cardiotoxicity in humans", "diril": "kidney injury in humans", "herg_karim": "blockade of the cardiac hERG channel", "herg": "blockade of the cardiac hERG channel", "herg_inhib": "blockade of the cardiac hERG channel",
    "skin_reaction": "allergic reactions of the skin", "carcinogens_lagunin": "cancer",
}
AS_ENDPOINT = ("herg_unified", "ames", "clintox", "dilist", "cyp1a2_veith", "cyp2c19_veith", "cyp2c9_veith", "cyp2d6_veith", "cyp3a4_veith")
AS_DATASET = ("dilist", "dictrank", "diril", "ames", "herg_karim", "herg", "herg_inhib", "herg_unified", "skin_reaction", "carcinogens_lagunin", "clintox")
CYP = AS_ENDPOINT[4:]

_EFFECT = "This molecule is known or expected to cause {}."
_TOX21 = "This molecule is active in the Tox21 assay on {}."
_TOX21_ANY = "This molecule is active in an assay of the Tox21 panel."
_SIDER = "This molecule has been reported with side effects of the class '{}'."
_METABOLISM = "This molecule inhibits a drug-metabolising enzyme."


def dimension(spark: SparkSession) -> DataFrame:
    """level, key, text: fixed size, so always broadcast."""
    rows = [("tox21", k, _TOX21.format(v)) for k, v in TOX21.items()] + [("sider", k, _SIDER.format(k)) for k in SIDER] + [("effect", k, _EFFECT.format(v)) for k, v in EFFECTS.items()]
    return spark.createDataFrame(rows, "level string, key string, text string")


def with_description(df: DataFrame, dataset: str = "dataset_name", endpoint: str = "endpoint", out: str = "description", generic_gate: bool = True) -> DataFrame:
    """Adds the description of each row by the cascade; '' where nothing matches.

    An endpoint that starts with tox21_ in any case is looked up by what is left once 'tox21_' as written is taken
    out, so TOX21_X falls to the panel's general text; then organ classes; then effects by endpoint; then by dataset;
    then the panels by dataset with the endpoint or their general text.
    """
    d, e = str_or_empty(F.col(dataset)), str_or_empty(F.col(endpoint))
    low_d, low_e = F.lower(d), F.lower(e)
    dim = dimension(df.sparkSession)
    level = lambda name, c: F.broadcast(dim.filter(F.col("level") == name).select(F.col("key").alias(f"__k_{c}"), F.col("text").alias(f"__t_{c}")))
    out_df = df.withColumns({"__bare": F.replace(e, F.lit("tox21_"), F.lit("")), "__le": low_e, "__ld": low_d, "__e": e})
    for name, c, key in (("tox21", "bare", "__bare"), ("tox21", "own", "__e"), ("sider", "sider", "__e"), ("effect", "ep", "__le"), ("effect", "ds", "__ld")):
        out_df = out_df.join(level(name, c), F.col(key) == F.col(f"__k_{c}"), "left")
    sider = F.coalesce("__t_sider", F.concat(F.lit(_SIDER.split("{}")[0]), F.col("__e"), F.lit(_SIDER.split("{}")[1])))
    text = (
        F.when(F.col("__le").startswith("tox21_"), F.coalesce("__t_bare", F.lit(_TOX21_ANY)))
        .when(F.col("__le").isin(*[s.lower() for s in SIDER]), sider)
        .when(F.col("__le").isin(*AS_ENDPOINT), F.col("__t_ep"))
        .when(F.col("__ld").isin(*AS_DATASET), F.col("__t_ds"))
        .when(F.col("__ld") == "tox21", F.when(F.col("__e") != "", F.coalesce("__t_own", F.lit(_TOX21_ANY))).otherwise(F.lit(_TOX21_ANY)))
        .when(F.col("__ld").isin("sider_train", "sider_test", "sider"), F.when(F.col("__e") != "", sider).otherwise(F.lit(_SIDER.replace(" of the class '{}'", ""))))
        .when(F.col("__ld") == "metabolism", F.when(F.col("__le").isin(*CYP), F.col("__t_ep")).otherwise(F.lit(_METABOLISM)))
        .otherwise(F.lit(""))
    )
    return out_df.withColumn(out, text).drop("__bare", "__le", "__ld", "__e", *[f"__{x}_{c}" for x in "kt" for c in ("bare", "own", "sider", "ep", "ds")])


def require_descriptions(df: DataFrame, out: str = "description", dataset: str = "dataset_name", endpoint: str = "endpoint") -> DataFrame:
    """Rows that name something must have a description: the query fails on one that has none."""
    named = (str_or_empty(F.col(dataset)) != "") | (str_or_empty(F.col(endpoint)) != "")
    missing = F.concat(F.lit("no description of "), F.coalesce(F.col(dataset), F.lit("")), F.lit("/"), F.coalesce(F.col(endpoint), F.lit("")))
    return df.withColumn(out, F.when(named & (F.col(out) == ""), F.raise_error(missing).cast("string")).otherwise(F.col(out)))


def unresolved(df: DataFrame, out: str = "description") -> Column:
    return F.count_if(F.col(out) == "")
