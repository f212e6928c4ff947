"""The known sources: name, category and the format of their files."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession


class Source(NamedTuple):
    name: str
    category: str
    format: str


# The TU collections that are staged; COIL-DEL has drawings.
TU = (
    "MUTAG AIDS ENZYMES PTC_MR PTC_FR PTC_MM PTC_FM DHFR COX2 BZR PROTEINS KKI Peking_1 Cuneiform MSRC_9 MSRC_21C IMDB-BINARY infectious_ct1 tumblr_ct1 dblp_ct1 BZR_MD COLLAB COLORS-3 DD deezer_ego_nets ER_MD "
    "facebook_ct1 FRANKENSTEIN GITHUB_STARGAZERS highschool_ct1 IMDB-MULTI mit_ct1 MSRC_21 Mutagenicity NCI-H23 NCI1 NCI109 OHSU QM9 REDDIT-BINARY REDDIT-MULTI-12K REDDIT-MULTI-5K Tox21_AhR_training "
    "Tox21_AR-LBD_training Tox21_AR_training Tox21_ARE_training Tox21_aromatase_training Tox21_ATAD5_training Tox21_ER-LBD_training Tox21_ER_training Tox21_HSE_training Tox21_MMP_training Tox21_p53_training "
    "Tox21_PPAR-gamma_training TRIANGLES TWITTER-Real-Graph-Partial Yeast ZINC_full"
).split()
# The other sources.
OTHERS = (
    Source("rome", "benchmark", "graphml_archive"), Source("north", "benchmark", "graphml_archive"), Source("random-dag", "benchmark", "graphml_archive"), Source("suitesparse_small", "real_world", "matrix_market_archive"),
    Source("food_webs", "real_world", "edge_list"), Source("netzschleuder/dom", "real_world", "csv_zip"), Source("netzschleuder/moreno_sociograms", "real_world", "csv_zip"), Source("netzschleuder/dutch_school", "real_world", "csv_zip"),
    Source("netzschleuder/internet_top_pop", "real_world", "csv_zip"), Source("netzschleuder/moviegalaxies", "real_world", "csv_zip"), Source("netzschleuder", "real_world", "csv_zip"), Source("ieee_pes", "real_world", "matpower"),
    Source("openflights_airports", "real_world", "routes"), Source("pajek", "graphs_with_drawings", "pajek_archive"), Source("wikipathways", "graphs_with_drawings", "gpml"), Source("ndex", "graphs_with_drawings", "cx"),
    Source("gd_collection_v1", "graphs_with_drawings", "geg_archive"), Source("houseofgraphs", "real_world", "adjacency_json"), Source("TUDataset/COIL-DEL", "graphs_with_drawings", "tu_archive"),
)
SOURCES = {s.name: s for s in (*OTHERS, *(Source(f"TUDataset/{n}", "real_world", "tu_archive") for n in TU))}


def format_for(name: str) -> str:
    """The format of a source, or of the longest registered source that it is a child of."""
    while name:
        if name in SOURCES:
            return SOURCES[name].format
        head, _, _ = name.rpartition("/")
        if not head and name.startswith("TUDataset"):
            return "tu_archive"
        name = "TUDataset" if head == "TUDataset" else head
    raise KeyError("no such source")


def select(category: str, names: list[str] | None = None) -> list[Source]:
    """Sources of a category: all ("*" or None) or those named, in order of name."""
    found = [s for s in SOURCES.values() if s.category == category and (names in (None, ["*"]) or s.name in names)]
    return sorted(found, key=lambda s: s.name)


def table(spark: SparkSession) -> DataFrame:
    """The registry as a table."""
    return spark.createDataFrame(sorted(SOURCES.values()), "source string, category string, format string")
