"""FASTA, A3M, Stockholm and table formats. A file is one row of text that is split in JVM expressions."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seqloom.functions.columns import chars


def whole_files(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """(source_file, value): one row per file."""
    return spark.read.text(path, wholetext=True, pathGlobFilter=glob).select(F.col("_metadata.file_path").alias("source_file"), "value")


def read_fasta(files: DataFrame, keep_mark: bool = False) -> DataFrame:
    """(source_file, ord, name, seq) of files: wrapped lines are joined, blank lines, ``#`` lines and text before the
    first ``>`` are skipped, a file without a last line end is fine. A record without sequence has an empty one."""
    record = files.select("source_file", F.posexplode(F.split(F.regexp_replace("value", r"\r\n?", "\n"), r"(?m)^>")).alias("ord", "r")).filter("ord > 0")
    line = F.split(F.col("r"), "\n")
    body = F.filter(F.slice(line, F.lit(2), F.greatest(F.size(line) - 1, F.lit(0))), lambda x: ~x.startswith("#"))
    name = F.trim(F.get(line, F.lit(0)))
    return record.select("source_file", (F.col("ord") - 1).alias("ord"), (F.concat(F.lit(">"), name) if keep_mark else name).alias("name"), F.regexp_replace(F.array_join(body, ""), r"\s", "").alias("seq"))


def read_fasta_records(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """(source_file, name, seq) of FASTA files of any size: a record is a line that ends at the next ``>``, so files are split
    like any text and no file is held in one cell. The same rules as read_fasta; the order of records isn't kept."""
    raw = spark.read.option("lineSep", "\n>").text(path, pathGlobFilter=glob).select(F.col("_metadata.file_path").alias("source_file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), "value")
    begins = F.col("value").startswith(">")  # only the first record of a file keeps its mark
    lead = raw.filter("block = 0").groupBy("source_file").agg(F.min(F.struct("at", begins.alias("marked"))).alias("f")).filter("not f.marked").select("source_file", F.col("f.at").alias("at"))
    parts = F.split(F.regexp_replace(F.when(begins, F.substring("value", F.lit(2), F.length("value"))).otherwise(F.col("value")), r"\r\n?", "\n"), "\n")
    body = F.filter(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), lambda x: ~x.startswith("#"))
    known = raw.join(lead, ["source_file", "at"], "left_anti").filter(F.trim("value") != "")  # text before a file's first mark is no record
    return known.select("source_file", F.trim(F.get(parts, F.lit(0))).alias("name"), F.regexp_replace(F.array_join(body, ""), r"\s", "").alias("seq"))


def write_fasta_records(records: DataFrame, out: str, order: list[str]) -> None:
    """Write (name, seq) as FASTA text below ``out``, one file for each range of ``order``; no file is gathered."""
    ranged = records.repartitionByRange(*order).sortWithinPartitions(*order)
    ranged.select(F.concat(F.lit(">"), "name", F.lit("\n"), "seq").alias("value")).write.text(out)


def read_two_line(files: DataFrame) -> DataFrame:
    """Strict dialect: names and sequences on alternating lines."""
    lines = files.select("source_file", F.posexplode(F.split(F.regexp_replace("value", r"\s+$", ""), "\n")).alias("n", "line"))
    half = lines.groupBy("source_file", F.floor(F.col("n") / 2).cast("int").alias("ord"))
    return half.agg(F.max(F.when(F.col("n") % 2 == 0, F.ltrim(F.col("line"), F.lit(">")))).alias("name"), F.max(F.when(F.col("n") % 2 == 1, F.col("line"))).alias("seq"))


def tag(name: Column) -> Column:
    """The part of a name before its first character that is no word character."""
    return F.regexp_extract(name, r"^(\w*)", 1)


def pick_regions(seq: Column, wanted: list[int], mark: str = "*") -> Column:
    """The chosen regions of a marked sequence, joined."""
    return F.array_join(F.filter(F.split(seq, "\\" + mark), lambda _, i: i.isin(wanted)), "")


def to_fasta(records: DataFrame, out: str) -> None:
    """Write (source_file, ord, name, seq) as one text per source_file, records in order, below ``out``."""
    line = F.concat(F.lit(">"), "name", F.lit("\n"), "seq")
    text = records.groupBy("source_file").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ord", line.alias("l")))), lambda x: x["l"]), "\n").alias("value"))
    text.withColumn("file", F.element_at(F.split("source_file", "/"), -1)).select("value", "file").write.partitionBy("file").text(out)


def zip_fasta(left: DataFrame, right: DataFrame) -> DataFrame:
    """Records of two files side by side: sequences joined by ``*``, names by ``|``; unequal counts are an error."""
    pair = left.select("ord", F.col("name").alias("ln"), F.col("seq").alias("ls")).join(right.select("ord", F.col("name").alias("rn"), F.col("seq").alias("rs")), "ord", "full_outer")
    whole = F.col("ls").isNotNull() & F.col("rs").isNotNull()
    checked = F.when(whole, F.concat_ws("*", "ls", "rs")).otherwise(F.raise_error(F.lit("the files have different numbers of records")))
    return pair.select("ord", F.concat_ws("|", "ln", "rn").alias("name"), checked.cast("string").alias("seq"))


def union_fasta(parts: list[DataFrame]) -> DataFrame:
    """All records of several files, in order of files; ``part`` names the file, ``group`` the name before ``|``."""
    out = None
    for i, p in enumerate(parts):
        one = p.select(F.lit(i).alias("part"), "ord", "name", "seq", F.element_at(F.split("name", "\\|"), 1).alias("group"))
        out = one if out is None else out.unionByName(one)
    return out


def read_a3m(files: DataFrame) -> DataFrame:
    """(source_file, row_idx, description, seq, deletions): lower-case letters are insertions; their number goes to the
    next column, trailing ones are dropped."""
    raw = F.col("raw")
    return read_fasta(files).withColumnRenamed("seq", "raw").select(
        "source_file", F.col("ord").alias("row_idx"), F.col("name").alias("description"), F.regexp_replace(raw, "[a-z]", "").alias("seq"), F.transform(F.regexp_extract_all(raw, F.lit("([a-z]*)[^a-z]"), 1), lambda x: F.length(x)).alias("deletions")
    )


def _stockholm_lines(files: DataFrame) -> DataFrame:
    lines = files.select("source_file", F.posexplode(F.split("value", r"\r?\n")).alias("n", "line")).withColumn("line", F.trim("line"))
    return lines.filter(F.col("line") != "")


def stockholm_records(files: DataFrame) -> DataFrame:
    """(source_file, row_idx, name, raw): blocks of one name joined, names in order of first appearance."""
    part = F.split("line", r"\s+")
    body = _stockholm_lines(files).filter(~F.col("line").startswith("#") & ~F.col("line").startswith("//")).select("source_file", "n", F.get(part, F.lit(0)).alias("name"), F.get(part, F.lit(1)).alias("piece"))
    joined = body.groupBy("source_file", "name").agg(F.min("n").alias("first"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n", "piece"))), lambda x: x["piece"]), "").alias("raw"))
    return joined.withColumn("row_idx", F.row_number().over(Window.partitionBy("source_file").orderBy("first")) - 1).drop("first")


def _with_query(records: DataFrame) -> DataFrame:
    query = records.filter("row_idx = 0").select("source_file", F.col("raw").alias("query"))
    return records.join(query, "source_file")


def read_stockholm(files: DataFrame) -> DataFrame:
    """(source_file, row_idx, description, seq, deletions): columns in which the query has a gap are dropped; residues
    there count as deletions before the next kept column."""
    q, s = chars(F.col("query")), chars(F.col("raw"))
    zero = F.struct(F.lit(0).alias("n"), F.array().cast("array<int>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        keep = x["q"] != "-"
        return F.struct(F.when(keep, 0).when(x["s"] != "-", acc["n"] + 1).otherwise(acc["n"]).alias("n"), F.when(keep, F.concat(acc["out"], F.array(acc["n"]))).otherwise(acc["out"]).alias("out"))

    pairs = F.zip_with(q, s, lambda a, b: F.struct(a.alias("q"), b.alias("s")))
    kept = F.array_join(F.transform(F.filter(pairs, lambda x: x["q"] != "-"), lambda x: x["s"]), "")
    return _with_query(stockholm_records(files)).select("source_file", "row_idx", F.col("name").alias("description"), kept.alias("seq"), F.aggregate(pairs, zero, step)["out"].alias("deletions"))


def stockholm_to_a3m(files: DataFrame, most: int | None = None, drop_query_gaps: bool = True) -> DataFrame:
    """(source_file, row_idx, name, a3m): residues in query gaps in lower case, or dropped gaps; ``DE`` texts follow the name."""
    about = _stockholm_lines(files).filter(F.col("line").startswith("#=GS")).select("source_file", F.regexp_extract("line", r"^#=GS\s+(\S+)\s+DE\s+(.*)$", 1).alias("name"), F.regexp_extract("line", r"^#=GS\s+(\S+)\s+DE\s+(.*)$", 2).alias("text")).filter("name <> ''")
    about = about.groupBy("source_file", "name").agg(F.min("text").alias("text"))
    pairs = F.zip_with(chars(F.col("query")), chars(F.col("raw")), lambda a, b: F.when(a != "-", b).when(b == "-", "").otherwise(F.lower(b)))
    a3m = F.translate(F.array_join(pairs, "") if drop_query_gaps else F.col("raw"), ".", "")
    out = _with_query(stockholm_records(files)).join(about, ["source_file", "name"], "left")
    out = out.select("source_file", "row_idx", F.concat_ws(" ", "name", "text").alias("name"), a3m.alias("a3m"))
    return out if most is None else out.filter(F.col("row_idx") < most)


def truncate_stockholm(files: DataFrame, most: int) -> DataFrame:
    """The records of the first ``most`` names of each file, as they stand."""
    return stockholm_records(files).filter(F.col("row_idx") < most)


def dedup_stockholm(files: DataFrame) -> DataFrame:
    """The first record of each sequence, as seen in the query's columns."""
    r = _with_query(stockholm_records(files))
    masked = F.array_join(F.zip_with(chars(F.col("query")), chars(F.col("raw")), lambda a, b: F.when(a != "-", b).otherwise("")), "")
    return r.groupBy("source_file", masked.alias("masked")).agg(F.min_by(F.struct("row_idx", "name", "raw"), "row_idx").alias("r")).select("source_file", "r.*")


def drop_empty_columns(files: DataFrame) -> DataFrame:
    """Records without the columns in which every record has a gap."""
    r = stockholm_records(files)
    full = r.select("source_file", F.posexplode(chars(F.col("raw"))).alias("pos", "c")).filter("c <> '-'").groupBy("source_file").agg(F.array_sort(F.collect_set("pos")).alias("keep"))  # at most one entry per column
    return r.join(full, "source_file").withColumn("raw", F.array_join(F.filter(chars(F.col("raw")), lambda _, i: F.array_contains("keep", i)), "")).drop("keep")


def read_tblout(files: DataFrame) -> DataFrame:
    """(source_file, target, e_value) of a tabular hit list, with the query at 0."""
    part = F.split("line", r"\s+")
    rows = _stockholm_lines(files).filter(~F.col("line").startswith("#")).select("source_file", F.get(part, F.lit(0)).alias("target"), F.get(part, F.lit(4)).cast("double").alias("e_value"))
    return rows.unionByName(files.select("source_file", F.lit("query").alias("target"), F.lit(0.0).alias("e_value")))


def read_clonotypes(spark: SparkSession, path: str) -> DataFrame:
    """(name, clonotype) of a CSV with a header; the last row of a name counts. The schema is given, not guessed."""
    rows = spark.read.option("header", True).option("enforceSchema", False).schema("name string, clonotype string").csv(path)
    rows = rows.withColumn("n", F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id()))  # the order of files, splits and lines
    return rows.groupBy("name").agg(F.max_by("clonotype", "n").alias("clonotype"))


def split_multi_a3m(files: DataFrame) -> DataFrame:
    """(source_file, part, name, text) of NUL-separated alignments; the name is the first word of the first line."""
    part = files.select("source_file", F.posexplode(F.split("value", "\x00")).alias("part", "text")).filter(F.trim("text") != "")
    return part.select("source_file", "part", F.regexp_extract("text", r"^>?(\S*)", 1).alias("name"), "text")


def bucket_catalog(paths: DataFrame, path: str = "path") -> DataFrame:
    """Chain type, lengths and count that a bucket's file name states: ``H_<c1>_<c2>_<c3>_<count>.fasta``."""
    f = F.split(F.regexp_replace(F.element_at(F.split(F.col(path), "/"), -1), r"\.fasta$", ""), "_")
    at = lambda i: F.get(f, F.lit(i))
    return paths.select(path, at(0).alias("chain_type"), *[at(i).cast("int").alias(n) for i, n in enumerate(["cdr1_len", "cdr2_len", "cdr3_len"], 1)], at(4).cast("long").alias("seq_count"))


def region_json(intervals: Column, chain_type: Column, length: Column, front: Column, back: Column) -> Column:
    """The region index of a chain as JSON: half-open intervals by name."""
    names = ["FR1", "CDR1", "FR2", "CDR2", "FR3", "CDR3", "FR4"]
    pair = lambda s, e: F.array(s.cast("int"), e.cast("int"))
    fields = [pair(F.get(intervals, F.lit(i))["s"], F.get(intervals, F.lit(i))["e"]).alias(n) for i, n in enumerate(names)]
    return F.to_json(F.struct(chain_type.alias("chain_type"), pair(F.lit(0), front).alias("FRONT"), *fields, pair(length - back, length).alias("BACK"), length.cast("int").alias("length")))


def read_region_json(df: DataFrame, col: str) -> DataFrame:
    names = ["FRONT", "FR1", "CDR1", "FR2", "CDR2", "FR3", "CDR3", "FR4", "BACK"]
    schema = "chain_type string, " + ", ".join(f"{n} array<int>" for n in names) + ", length int"
    return df.withColumn("index", F.from_json(col, schema))


def build_index(files: DataFrame) -> DataFrame:
    """(db, name, start, size): byte offsets of files that are laid end to end in order of their names, per ``db``."""
    w = Window.partitionBy("db").orderBy("name").rowsBetween(Window.unboundedPreceding, -1)
    return files.withColumn("size", F.octet_length("value").cast("long")).select("db", "name", F.coalesce(F.sum("size").over(w), F.lit(0)).alias("start"), "size")


def read_range(blobs: DataFrame, index: DataFrame, block: int = 1 << 16) -> DataFrame:
    """(db, name, value): the bytes of each index entry. blobs: db, content and, where a file comes in several parts, ``at``, the
    offset of the part.

    Contents are cut into blocks once and an entry meets only the blocks that its range touches, so no row carries a file.
    """
    parts = blobs if "at" in blobs.columns else blobs.withColumn("at", F.lit(0))
    parts = parts.select("db", F.col("at").cast("long").alias("at"), "content").filter(F.octet_length("content") > 0)
    first = lambda x: F.floor(x / block).cast("long")
    end = F.col("at") + F.octet_length("content")

    def piece(k: Column) -> Column:
        begin = F.greatest(F.col("at"), k * block)
        cut = F.substring(F.col("content"), (begin - F.col("at") + 1).cast("int"), (F.least(end, (k + 1) * block) - begin).cast("int"))
        return F.struct(k.alias("block"), begin.alias("begin"), cut.alias("bytes"))

    pieces = parts.select("db", F.explode(F.transform(F.sequence(first(F.col("at")), first(end - 1)), piece)).alias("p")).select("db", "p.*")
    entry = ["db", "name", "start", "size"]
    asked = index.select(*entry).join(blobs.select("db").distinct(), "db")
    asked = asked.withColumn("block", F.explode(F.sequence(first(F.col("start")), first(F.col("start") + F.greatest(F.col("size"), F.lit(1)) - 1))))
    last = F.col("start") + F.col("size")
    met = asked.alias("i").join(pieces.alias("p"), (F.col("i.db") == F.col("p.db")) & (F.col("i.block") == F.col("p.block")) & (F.col("begin") < last) & (F.col("begin") + F.octet_length("bytes") > F.col("start")), "left")
    low = F.greatest(F.col("start"), F.col("begin"))
    own = F.substring(F.col("bytes"), (low - F.col("begin") + 1).cast("int"), F.greatest(F.least(last, F.col("begin") + F.octet_length("bytes")) - low, F.lit(0)).cast("int"))
    met = met.select(*[F.col(f"i.{c}").alias(c) for c in (*entry, "block")], "begin", own.alias("own"))
    held = met.groupBy(*entry).agg(F.collect_set(F.struct("block", "begin", "own")).alias("parts"), F.count(F.lit(1)).alias("n"))
    value = F.aggregate(F.array_sort("parts"), F.lit(b"").cast("binary"), lambda a, x: F.concat(a, F.coalesce(x["own"], F.lit(b"").cast("binary"))))
    held = held.select("db", "name", F.decode(value, "UTF-8").alias("value"), F.explode(F.sequence(F.lit(1), (F.col("n") / F.size("parts")).cast("int"))))  # entries that repeat
    return held.select("db", "name", "value")


def read_file_ranges(index: DataFrame, folder: str) -> DataFrame:
    """(db, name, value): the bytes of each index entry (db, name, start, size), read from the files ``folder/db`` by seeking.

    Files may be of any size; only the ranges are read. The folder must be mounted on every executor."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            values = []
            for db, start, size in zip(batch["db"], batch["start"], batch["size"]):
                with open(f"{folder}/{db}", "rb") as file:
                    file.seek(int(start))
                    values.append(file.read(int(size)).decode("utf-8", "replace"))
            yield batch[["db", "name"]].assign(value=values)

    return index.select("db", "name", "start", "size").mapInPandas(read, "db string, name string, value string")


def unify_indices(indices: list[DataFrame]) -> DataFrame:
    """One index of several; the later one wins."""
    out = None
    for i, x in enumerate(indices):
        one = x.withColumn("__i", F.lit(i))
        out = one if out is None else out.unionByName(one)
    return out.groupBy("name").agg(F.max_by(F.struct("db", "start", "size"), "__i").alias("r")).select("name", "r.*")
