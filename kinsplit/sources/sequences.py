"""Sequence, molecule and structure files as DataFrames (id, label, item).

Line files are read in splits, so a file may be of any size; a record may cross splits. Records keep the order of the
file, and ids count from 0 over all files in order of their paths. Structures are one row a file, as each is one item.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from kinsplit.plans.ranking import numbered
from kinsplit.plans.storage import materialize


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, block, line_no, line) of each line of each file, line_no counting from 0 in its file.

    A split's lines are numbered as they are read; the counts of the splits, a row each, give the rest.
    """
    read = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), F.col("value").alias("line"))
    read = materialize(read, "lines")
    blocks = read.groupBy("path", "block").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    before = W.partitionBy("path").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    blocks = blocks.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    return read.join(F.broadcast(blocks), ["path", "block"]).select("path", "block", (F.col("at") - F.col("first") + F.col("before")).alias("line_no"), "line")


def _records(lines: DataFrame, mark: Column) -> DataFrame:
    """``lines`` with ``at``: how many marked lines there are up to it in its file.

    Marks are counted in each split, whose size is bounded, and summed over the splits before.
    """
    upto = W.partitionBy("path", "block").orderBy("line_no").rowsBetween(W.unboundedPreceding, W.currentRow)
    counted = lines.withColumn("mark", mark.cast("int")).withColumn("at", F.sum("mark").over(upto))
    sums = counted.groupBy("path", "block").agg(F.sum("mark").alias("marks"))
    before = W.partitionBy("path").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.withColumn("before", F.coalesce(F.sum("marks").over(before), F.lit(0))).drop("marks")
    return counted.join(F.broadcast(sums), ["path", "block"]).withColumn("at", F.col("at") + F.col("before")).drop("before", "block")


def _numbered(df: DataFrame) -> DataFrame:
    """Ids in order of path and place."""
    return numbered(df, "id", "path", "at")


def _exists(path: str) -> None:
    if "://" not in path and not any(c in path for c in "*?[{") and not os.path.exists(path):
        raise OSError(f"no such file: {path}")


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(id, header, sequence). Lines are trimmed, blank ones and those before the first header dropped, sequence lines joined."""
    _exists(path)
    lines = _lines(spark, path).withColumn("line", F.trim("line")).where("line <> ''")
    rec = _records(lines, F.col("line").startswith(">")).where("at > 0")
    rows = rec.groupBy("path", "at").agg(F.sort_array(F.collect_list(F.struct("line_no", "line"))).alias("l"))
    rows = rows.select("path", "at", F.expr("substring(l[0].line, 2)").alias("header"), F.array_join(F.transform(F.expr("slice(l, 2, size(l))"), lambda x: x["line"]), "").alias("sequence"))
    return _numbered(rows).select("id", "header", "sequence")


def read_smi(spark: SparkSession, path: str) -> DataFrame:
    """(id, label, smiles): ``SMILES [name]`` a line; blank and # lines skipped; without a name the label is the line's number from 0."""
    _exists(path)
    lines = _lines(spark, path).withColumn("line", F.trim("line")).where("line <> '' and not startswith(line, '#')")
    p = F.split("line", r"\s+", 2)
    rows = lines.select("path", F.col("line_no").alias("at"), p[0].alias("smiles"), F.coalesce(F.nullif(F.trim(F.get(p, F.lit(1))), F.lit("")), F.col("line_no").cast("string")).alias("label"))
    return _numbered(rows).select("id", "label", "smiles")


def read_csv_mol(spark: SparkSession, path: str) -> DataFrame:
    """(id, label, smiles) of a table with a header: the column named smiles in any case; the label is the first column. Commas are not quoted."""
    _exists(path)
    lines = _lines(spark, path).where("trim(line) <> ''")
    head = lines.where("line_no = 0").select("line").first()
    names = [x.strip().lower() for x in (head["line"] if head else "").split(",")]
    if "smiles" not in names:
        raise OSError(f"{path} has no smiles column")
    p = F.split("line", ",")
    rows = lines.where("line_no > 0").select("path", F.col("line_no").alias("at"), F.trim(F.get(p, F.lit(0))).alias("label"), F.trim(F.get(p, F.lit(names.index("smiles")))).alias("smiles"))
    return _numbered(rows).select("id", "label", "smiles")


def read_sdf(spark: SparkSession, path: str) -> DataFrame:
    """(id, label, molblock) of records parted by $$$$; the label is the record's number."""
    _exists(path)
    end = F.col("line").startswith("$$$$")
    rec = _records(_lines(spark, path), end).withColumn("at", F.col("at") - F.col("mark")).where("mark = 0")
    rows = rec.groupBy("path", "at").agg(F.sort_array(F.collect_list(F.struct("line_no", "line"))).alias("l"))
    rows = rows.select("path", "at", F.concat(F.array_join(F.transform("l", lambda x: x["line"]), "\n"), F.lit("\n")).alias("molblock")).where(r"molblock rlike '\\S'")
    return _numbered(rows).select("id", F.col("id").cast("string").alias("label"), "molblock")


def read_molecule_file(spark: SparkSession, path: str) -> DataFrame:
    """By extension: .sdf, .smi, .smiles or .csv; OSError otherwise."""
    readers = {".sdf": read_sdf, ".smi": read_smi, ".smiles": read_smi, ".csv": read_csv_mol}
    ext = os.path.splitext(path)[1].lower()
    if ext not in readers:
        raise OSError(f"unknown molecule file type {ext!r}: .sdf, .smi, .smiles or .csv")
    return readers[ext](spark, path)


def molecule_fingerprints(df: DataFrame, column: str = "smiles", kind: str = "morgan", radius: int = 2, n_bits: int = 2048) -> DataFrame:
    """``df`` with ``item``: on-bits of Morgan (radius, n_bits) or MACCS fingerprints. Needs RDKit on the executors.

    Without RDKit use :func:`text_fingerprints`, which knows no chemistry.
    """
    try:
        import rdkit  # noqa: F401
    except ImportError as e:
        raise RuntimeError("RDKit is needed for molecule fingerprints and is not installed; text_fingerprints works on the strings") from e
    import pandas as pd

    @F.pandas_udf("array<int>")
    def f(s: pd.Series) -> pd.Series:
        from rdkit import Chem
        from rdkit.Chem import MACCSkeys, rdFingerprintGenerator

        gen = rdFingerprintGenerator.GetMorganGenerator(radius=radius, fpSize=n_bits)

        def one(x):
            mol = Chem.MolFromMolBlock(x) if "\n" in x else Chem.MolFromSmiles(x)
            if mol is None:
                raise ValueError(f"cannot read the molecule {x[:80]!r}")
            return list((gen.GetFingerprint(mol) if kind == "morgan" else MACCSkeys.GenMACCSKeys(mol)).GetOnBits())

        return s.map(one)

    return df.withColumn("item", f(F.col(f"`{column}`")))


def text_fingerprints(df: DataFrame, column: str, n: int = 3, n_bits: int = 2048) -> DataFrame:
    """``df`` with ``item``: on-bits of the hashed character n-grams of a string column."""
    s = F.col(f"`{column}`")
    grams = F.when(F.length(s) >= n, F.transform(F.sequence(F.lit(1), F.length(s) - n + 1), lambda i: F.substring(s, i, F.lit(n)))).otherwise(F.array(s))
    return df.withColumn("item", F.sort_array(F.array_distinct(F.transform(grams, lambda g: F.pmod(F.xxhash64(g), F.lit(n_bits)).cast("int")))))


def read_pdb(spark: SparkSession, path: str) -> DataFrame:
    """(id, label, item): the text of each PDB file as item of the structure kernel; the label is its path."""
    _exists(path)
    whole = spark.read.format("binaryFile").load(path).select("path", F.decode("content", "UTF-8").alias("item"), F.lit(0).alias("at"))
    return _numbered(whole).select("id", F.col("path").alias("label"), "item")
