"""Names of sources and labels, and the registry of source columns."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

# Behaviour labels; the code of a label is its position.
LABELS = [
    "1_normal",
    "2_ransomware",
    "3_thetick",
    "4_bashlite",
    "5_httpbackdoor",
    "6_beurk",
    "7_backdoor",
    "8_bdvl",
    "9_xmrig",
]

# Spellings found in the raw folders and their canonical names.
LABEL_ALIASES = {
    "1_normal_4h": "1_normal",
    "2_ransomware_4h": "2_ransomware",
    "3_thetick_4h": "3_thetick",
    "5_httpbackcoor": "5_httpbackdoor",
}
SOURCE_ALIASES = {
    "BLOCK": "block_data",
    "Block": "block_data",
    "ENTROPY": "entropy_data",
    "Entropy": "entropy_data",
    "FLSYS": "FLS_data",
    "KERN": "KERN_data",
    "NET": "network_data",
    "Network": "network_data",
    "RES": "RES_data",
}

# Columns of the narrow sources. The performance-counter sources (FLS_data,
# KERN_data, RES_data) have hundreds of event names that depend on kernel and board; they are
# a parameter, usually learned from file headers with ``registry_from_headers``.
BLOCK_COLUMNS = [
    "read_ops", "write_ops", "read_kbs", "write_kbs", "avgrq_sz", "avg_queue",
    "await", "r_await", "w_await", "svctm", "util",
]
NETWORK_COLUMNS = ["Protocol", "SourceIP", "SourcePort", "DestIP", "DestPort", "Length"]
ENTROPY_COLUMNS = ["file_path", "action", "entropy"]

# Order in which a column shared by several sources is attributed.
SOURCE_ORDER = ["block_data", "FLS_data", "KERN_data", "network_data", "RES_data", "RES_data_rp4", "SYS_data", "entropy_data"]
# Second variant of one source, folded to it when features are attributed.
SOURCE_FOLD = {"RES_data_rp4": "RES_data"}

# Columns that never belong to a source's own set.
NON_FEATURE_COLUMNS = {"index", "timestamp", "time", "Time"}


class SourceRegistry:
    """Source name -> exact column set, in attribution order."""

    def __init__(self, columns: Mapping[str, Iterable[str]] | None = None):
        known = {
            "block_data": BLOCK_COLUMNS,
            "network_data": NETWORK_COLUMNS,
            "entropy_data": ENTROPY_COLUMNS,
            "SYS_data": [],
        }
        known.update(columns or {})
        rank = {s: i for i, s in enumerate(SOURCE_ORDER)}
        self.columns = {
            s: frozenset(c.strip() for c in known[s]) for s in sorted(known, key=lambda s: rank.get(s, len(rank)))
        }

    def classify(self, columns: Sequence[str]) -> str:
        """Source whose set equals the table's columns, time columns and "index" aside."""
        found = frozenset(c.strip() for c in columns) - NON_FEATURE_COLUMNS
        for source, names in self.columns.items():
            if names and names == found:
                return source
        raise ValueError(f"no source has exactly the columns {sorted(found)}")

    def source_of(self, column: str) -> str:
        for source, names in self.columns.items():
            if column.strip() in names:
                return source
        raise ValueError(f"no source has the column {column!r}")

    def by_name(self, name: str) -> str:
        canonical = SOURCE_ALIASES.get(name, name)
        if canonical not in self.columns:
            raise ValueError(f"unknown source {name!r}")
        return canonical

    def wanted(self, source: str, selected: Iterable[str], columns: Iterable[str] = ()) -> bool:
        """Whether a scan of the source is worthwhile for the selected features.

        Sources whose features are engineered or vocabulary-driven are always read. ``columns`` are
        those of the table at hand, for a source or variant that is not registered.
        """
        if source in ("SYS_data", "entropy_data", "network_data"):
            return True
        names = set(columns).union(*(c for s, c in self.columns.items() if s == source or source_of_variant(s) == source))
        return bool(names & set(selected))

    def frame(self, spark: SparkSession) -> DataFrame:
        """(feature, data_source, ord): the registry as a table for joins."""
        rows = [(c, s, i) for i, (s, names) in enumerate(self.columns.items()) for c in sorted(names)]
        return spark.createDataFrame(rows, "feature string, data_source string, ord int")


def registry_from_headers(headers: DataFrame) -> SourceRegistry:
    """Learns the column sets from (data_source, columns ARRAY<STRING>), one row per distinct header.

    All headers of a source are kept: the most complete one under the source's own name, the others
    as variants (the first of them under the name that ``SOURCE_ORDER`` lists, if it lists one).
    """
    rows = headers.select("data_source", F.array_sort(F.array_distinct("columns")).alias("columns")).distinct().collect()
    found: dict[str, set[frozenset]] = {}
    for row in rows:
        found.setdefault(row["data_source"], set()).add(frozenset(c.strip() for c in row["columns"]) - NON_FEATURE_COLUMNS)
    learned: dict[str, frozenset] = {}
    for source, sets in found.items():
        ordered = sorted(sets, key=lambda names: (-len(names), sorted(names)))
        for number, names in enumerate(ordered):
            learned[variant_name(source, number)] = names
    return SourceRegistry(learned)


def variant_name(source: str, number: int) -> str:
    """Name of the n-th header variant of a source; 0 is the source itself."""
    if number == 0:
        return source
    second = f"{source}_rp4"
    return second if number == 1 and second in SOURCE_ORDER else f"{source}_v{number + 1}"


def source_of_variant(name: str) -> str:
    """The source that a registered name belongs to."""
    return re.sub(r"(?<=_data)_(?:rp4|v\d+)$", "", name)
