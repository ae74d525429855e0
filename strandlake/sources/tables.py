"""Saved results: Parquet tables next to the hash settings they were made with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..spec import HashSpec

# Columns each kind of saved result must have.
LAYOUTS = {
    "sketch": {"sketch": ("hash", "depth", "copy")},
    "reference": {
        "ref_hits": ("ref_id", "ref_ord", "hash", "offset"),
        "ref_seqs": ("ref_id", "name", "len"),
    },
    "readset": {
        "reads": ("read_id", "len", "n_hit", "n_miss", "n_copy0", "n_copy1", "n_copy2", "n_copy3"),
        "read_hits": ("read_id", "ord", "pos", "hash", "is_fwd", "copy"),
    },
    "incidence": {"inc": ("barcode", "hash", "read"), "codes": ("barcode", "n_read", "n_hash")},
}
_SPEC_SCHEMA = "k int, w int, factor bigint"


def save(kind: str, root: str, spec: HashSpec, mode: str = "errorifexists", **tables: DataFrame) -> None:
    """Write the tables of one result under ``root``, with its hash settings."""
    layout = LAYOUTS[kind]
    if set(tables) != set(layout):
        raise ValueError(f"{kind} needs the tables {sorted(layout)}")
    for name, columns in layout.items():
        missing = set(columns) - set(tables[name].columns)
        if missing:
            raise ValueError(f"{name} lacks {sorted(missing)}")
    spark = next(iter(tables.values())).sparkSession
    for name, df in tables.items():
        df.write.mode(mode).parquet(f"{root}/{name}")
    settings = [(spec.k, spec.w, spec.factor)]
    spark.createDataFrame(settings, _SPEC_SCHEMA).coalesce(1).write.mode(mode).json(f"{root}/spec")


def load(spark: SparkSession, kind: str, root: str) -> tuple[HashSpec, dict[str, DataFrame]]:
    """Read what :func:`save` wrote, checking kind and columns."""
    row = spark.read.schema(_SPEC_SCHEMA).json(f"{root}/spec").head()
    tables = {}
    for name, columns in LAYOUTS[kind].items():
        tables[name] = spark.read.parquet(f"{root}/{name}")
        missing = set(columns) - set(tables[name].columns)
        if missing:
            raise ValueError(f"{root} is no {kind}: {name} lacks {sorted(missing)}")
    return HashSpec(row["k"], row["w"], row["factor"]), tables


def save_bucketed(df: DataFrame, table: str, buckets: int, key: str = "hash") -> None:
    """Save as a catalog table bucketed and sorted by ``key``: later joins on it need no shuffle."""
    df.write.bucketBy(buckets, key).sortBy(key).mode("overwrite").saveAsTable(table)


def write_report(df: DataFrame, path: str, tag: str | None = None) -> None:
    """Tab-separated text, each line led by ``tag``."""
    columns = [F.lit(tag).alias("tag")] if tag else []
    df.select(*columns, *[F.col(c).cast("string") for c in df.columns]).write.csv(path, sep="\t")
