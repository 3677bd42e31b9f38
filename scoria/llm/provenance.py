"""Generated, minified, vendored and data files among source files (problem 5)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoria.operators.centrality import components
from scoria.operators.snapshots import latest_rows
from scoria.plans.runtime import checkpointed, shared_path

#: Directories that package managers and people keep other people's code in, by their exact names.
VENDOR_DIRS = r"(?:^|/)(?:node_modules|bower_components|jspm_packages|vendor|vendored|_vendor|_vendored|third[-_]?party|3rd[-_]?party|external|externals|extern|deps|site-packages|dist-packages|Carthage/Checkouts|Pods|\.yarn)/"
#: Endings that generators and minifiers give to the files they write.
MADE_SUFFIX = r"(?:\.min\.(?:js|css|mjs)|\.bundle\.js|\.pb\.(?:go|cc|h)|_pb2(?:_grpc)?\.py|\.(?:g|gen|generated|designer|Designer)\.\w+)$"
#: A comment's start, and what a generator's banner says after it (English, German, French, Spanish, Japanese).
OPEN = r"^\s*(?://+!?|#+!?|/?\*+!?|--|;+|<!--)\s*"
BANNER = rf"(?i){OPEN}(?:@generated\b(?:\s+(?:by|from|with)\b|\s*$)|<auto-?generated\b|code generated by\b|(?:this (?:file|code|module) (?:is|was|has been) )?(?:auto-?|automatically |machine[- ])?(?:generated|produced|created) (?:by|from|with) .*(?:do not (?:edit|modify|touch)|changes will be lost|overwritten)|this (?:file|code|module) (?:is|was|has been) (?:auto-?|automatically |machine[- ])?(?:generated|produced)\b|machine[- ](?:written|made|generated) (?:by|from)\b|automatisch (?:erzeugt|generiert|erstellt)\b|.*nicht von hand (?:ändern|bearbeiten)|.*\b(?:généré|produit) (?:par|depuis|à partir)\b.*ne pas|fichier généré\b|(?:archivo|fichero) (?:creado|generado) por\b|.*(?:generado|creado) (?:por|a partir)\b.*no (?:modificar|editar)|.*自動生成|.*do not edit[.!]?\s*(?:\*/|-->)?\s*$)"
#: The first lines of a library's copy: its name with a version and a notice, or where it was copied from.
COPIED = rf"(?i){OPEN}(?:[\w.@/-]+ v?\d+\.\d+(?:\.\d+)*\s+[-–—:]\s+(?:upstream|vendored|verbatim|unmodified) copy\b|copied (?:verbatim )?from \S+ v?\d+\.\d|vendored (?:copy of|from) \S+|(?:this file is )?part of \S+ v?\d+\.\d|@license \S+ v?\d+\.\d|[\w.@/-]+ v?\d+\.\d+(?:\.\d+)*\s*\|\s*(?:\(c\)|©|copyright|https?:))"
COMMENT_LINE = r"^\s*(?://|#(?!\s*(?:include|define|if|pragma|\[|!\[))|/?\*|--|<!--|$)"
#: A slot's number in a name and as index beside it, as accessor generators write them.
NUMBERED_SLOT = r"[A-Za-z]_?(\d{1,6})\s?\([^\n]{0,160}(?:\n[^\n]{0,160})?\[\1\]"
LITERALS = r"\"[^\"\n]*\"|'[^'\n]*'|\b(?:0[xX][0-9a-fA-F]+|\d[\w.]*)|[\s,;:=\[\]{}()+-]"


def _lines(text: Column) -> Column:
    return F.split(F.regexp_replace(F.regexp_replace(text, "^﻿", ""), r"\r\n?", "\n"), "\n")


def file_evidence(files: DataFrame, least_minified: int = 500, least_data: int = 300) -> DataFrame:
    """(file_id, repo, path, language, made, minified, data, copied, size, leaf), one row per file.

    `leaf` is the hash of the contents as a copy keeps them: without the comment block at the top, marks of byte order,
    kinds of line end and blanks at line ends. Null and empty texts have no evidence but the path. Code of fewer
    characters than the two bounds is no evidence of minifying or of data: so little can look like either by chance.
    """
    cols = {"path": "normalized_path", "repo": "repo", "language": "language", "text": "source_text"}
    one = latest_rows(files.where(F.col("file_id").isNotNull()), ["file_id"], "delivered_at", list(cols.values()))
    f = one.select("file_id", *[F.col(c).alias(n) for n, c in cols.items()]).withColumn("text", F.coalesce("text", F.lit(""))).withColumn("path", F.coalesce("path", F.lit("")))
    f = f.withColumn("lines", _lines(F.col("text")))
    first_code = F.array_position(F.transform("lines", lambda x: ~x.rlike(COMMENT_LINE)), True)
    f = f.withColumn("first_code", first_code.cast("int"))
    top = F.when(F.col("first_code") > 1, F.slice("lines", F.lit(1), F.col("first_code") - 1)).when(F.col("first_code") == 1, F.array().cast("array<string>")).otherwise(F.col("lines"))
    body = F.when(F.col("first_code") > 0, F.slice("lines", F.col("first_code"), F.size("lines"))).otherwise(F.array().cast("array<string>"))
    f = f.withColumns({"top": top, "body": F.array_join(F.transform(body, F.rtrim), "\n")}).withColumn("body", F.expr(r"trim(BOTH ' \n' FROM body)"))
    said = lambda pattern: F.exists("top", lambda x: x.rlike(pattern))
    json = F.lower(F.coalesce("language", F.lit(""))).isin("json") | F.lower("path").endswith(".json")
    filled = F.size(F.filter("lines", lambda x: ~x.rlike(r"^\s*$")))
    code = F.array_join(F.filter("lines", lambda x: ~x.rlike(COMMENT_LINE)), "\n")
    bare = F.length(F.regexp_replace(F.col("text"), r"\s", ""))
    f = f.withColumns({"json": json, "code": code})
    return f.select(
        "file_id", "repo", "path", "language",
        (said(BANNER) | F.col("path").rlike(MADE_SUFFIX) | (F.regexp_count("text", F.lit(NUMBERED_SLOT)) >= 5)).alias("made"),
        (~F.col("json") & (F.length("code") >= least_minified) & (F.length("text") >= 150 * F.greatest(filled, F.lit(1))) & (bare >= 0.9 * F.length("text"))).alias("minified"),
        (~F.col("json") & (F.length("code") >= least_data) & (F.length(F.regexp_replace("code", LITERALS, "")) <= 0.12 * F.length("code"))).alias("data"),
        (said(COPIED) | F.col("path").rlike(VENDOR_DIRS)).alias("copied"),
        F.length("body").cast("long").alias("size"), F.sha2("body", 256).alias("leaf"), "json",
    )


def merkle_tree(leaves: DataFrame, seeds: tuple[int, int] = (11, 97)) -> DataFrame:
    """(repo, node, hash, size, files) of every directory and file, hashed bottom-up level by level.

    `leaves` has (repo, path, leaf, size). A directory's hash is that of the multiset of its children's hashes,
    whatever their names, kept as sums so that a directory of any number of children is combined inside each task
    first. The root of a repository isn't a node.

    Each level is written before the next is hashed, so no plan grows with the depth of the paths.
    """
    spark = leaves.sparkSession
    columns = ["repo", "node", "hash", "size", "files"]
    level = leaves.select("repo", F.col("path").alias("node"), F.col("leaf").alias("hash"), F.col("size").cast("long").alias("size"), F.lit(1).cast("long").alias("files"), F.size(F.split("path", "/")).alias("depth"))
    files = checkpointed(level)
    deepest = files.agg(F.max("depth")).first()[0] or 0
    root = shared_path(spark)
    above = None
    for depth in range(deepest - 1, 0, -1):
        here = files.where(F.col("depth") == depth + 1).select(columns)
        current = here if above is None else here.unionByName(above)
        sums = [F.sum(F.xxhash64("hash", F.lit(s)).cast("decimal(20,0)")).alias(f"sum{s}") for s in seeds]
        up = current.groupBy("repo", F.regexp_replace("node", r"/[^/]*$", "").alias("node")).agg(*sums, F.sum("size").alias("size"), F.sum("files").alias("files"), F.count(F.lit(1)).alias("n"))
        up.select("repo", "node", F.sha2(F.concat_ws(":", "n", *[f"sum{s}" for s in seeds]), 256).alias("hash"), "size", "files").write.parquet(f"{root}/depth={depth}")
        above = spark.read.schema(files.select(columns).schema).parquet(f"{root}/depth={depth}")
    folders = None if above is None else spark.read.schema(files.select(columns).schema).parquet(*[f"{root}/depth={d}" for d in range(1, deepest)])
    return files.select(columns) if folders is None else files.select(columns).unionByName(folders)


def families(leaves: DataFrame, share: float = 0.25) -> DataFrame:
    """(repo, family) of the repositories that are related: forks and copies of one another as a whole.

    Two repositories are related if the files that both hold with the same contents at the same path are at least
    `share` of the files of the smaller one. Of the holders of one file each is compared with the first by name, not
    with all others; relations are followed through. Repositories without any aren't listed.
    """
    placed = leaves.select("repo", "path", "leaf").distinct()
    first = placed.groupBy("path", "leaf").agg(F.min("repo").alias("other"), F.count(F.lit(1)).alias("holders")).where("holders > 1")
    counts = leaves.groupBy("repo").agg(F.count_distinct("path").alias("n"))
    both = placed.join(first, ["path", "leaf"]).where(F.col("repo") != F.col("other")).groupBy("repo", "other").agg(F.count(F.lit(1)).alias("common"))
    near = both.join(counts, "repo").join(counts.select(F.col("repo").alias("other"), F.col("n").alias("m")), "other").where(F.col("common") >= share * F.least("n", "m"))
    return components(near, "repo", "other").select(F.col("node").alias("repo"), F.col("component").alias("family"))


def shared_subtrees(leaves: DataFrame, least: int = 200) -> DataFrame:
    """(repo, node) of the files and directories of at least `least` characters that stand in unrelated repositories.

    Shorter ones, such as empty package files, are equal by chance.
    """
    leaves = checkpointed(leaves)
    tree = merkle_tree(leaves).where(F.col("size") >= least)
    known = tree.join(families(leaves), "repo", "left").withColumn("family", F.coalesce("family", "repo"))
    shared = known.groupBy("hash").agg(F.min("family").alias("a"), F.max("family").alias("b")).where(F.col("a") != F.col("b")).select("hash")
    return tree.join(shared, "hash", "left_semi").select("repo", "node")


def not_handwritten(files: DataFrame) -> DataFrame:
    """(file_id, reason) of the files that nobody wrote by hand for their project.

    Reasons, the first that holds: generated, minified, data, vendored (by its place, its notice, or because the same
    contents or directory stand in an unrelated repository; a fork and its origin are related). Defined cases: of rows delivered repeatedly the last holds;
    null file ids are ignored; files of a null repository are judged alone; null and empty texts only by their path;
    JSON is never data or minified, as it may be kept by hand. Other columns aren't read.
    """
    seen = checkpointed(file_evidence(files))
    shared = shared_subtrees(seen.where(F.col("repo").isNotNull() & ~F.col("json")).select("repo", "path", "leaf", "size"))
    steps = F.split("path", "/")
    up = seen.where(F.col("repo").isNotNull()).select("file_id", "repo", F.explode(F.transform(F.sequence(F.lit(1), F.size(steps)), lambda i: F.array_join(F.slice(steps, F.lit(1), i), "/"))).alias("node"))
    inside = up.join(shared, ["repo", "node"], "left_semi").select("file_id").distinct().withColumn("shared", F.lit(True))
    reason = F.when(F.col("made"), "generated").when(F.col("minified"), "minified").when(F.col("data"), "data").when(F.col("copied") | F.col("shared"), "vendored")
    return seen.join(inside, "file_id", "left").select("file_id", reason.alias("reason")).where("reason IS NOT NULL")
