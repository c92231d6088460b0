"""References between documents: found in text, resolved to documents, followed, counted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MOST_PER_CHUNK = 8
LEAST_NAME_CHARACTERS, LEAST_NAME_WORDS = 6, 2
# --- fixed values: the words of a label and of a section ------------------------------------
LABELS = ("exhibit", "appendix", "schedule", "annex", "attachment", "addendum")
SECTIONS = ("section", "clause", "article")
_GAP = r"[\s\x{00a0}]"
LABEL = rf"\b(?i:({'|'.join(LABELS)})){_GAP}+(?i:no\.?{_GAP}*|#{_GAP}*)?([A-Z](?![A-Za-z])|\d+(?:\.\d+)*)"
SECTION = rf"\b(?i:({'|'.join(SECTIONS)})){_GAP}+(\d+(?:\.\d+)*)\b"
SIGN = rf"§{_GAP}*(\d+(?:\.\d+)*)"


def plain_name(name: Column) -> Column:
    """A document id or file name as words in lower case: no folder, no extension."""
    base = F.regexp_replace(F.substring_index(name, "/", -1), r"\.[A-Za-z0-9]{1,5}$", "")
    return F.lower(F.trim(F.regexp_replace(base, r"[^0-9A-Za-z]+", " ")))


def plain_words(text: Column) -> Column:
    return F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), r"[^0-9A-Za-z]+", " "))


def names(documents: DataFrame, column: str = "document_id") -> DataFrame:
    """(name, target_doc): every document under its plain name and without leading numbers; of one name the smallest id stays."""
    one = documents.select(F.col(column).alias("target_doc")).where("target_doc is not null").distinct().withColumn("name", plain_name(F.col("target_doc")))
    bare = one.withColumn("bare", F.regexp_replace("name", r"^\d+\s+", ""))
    long = (F.length("bare") >= LEAST_NAME_CHARACTERS) | (F.size(F.split("bare", " ")) >= LEAST_NAME_WORDS)
    short = bare.where((F.col("bare") != F.col("name")) & long).select(F.col("bare").alias("name"), "target_doc", F.lit(1).alias("order"))
    every = one.where("name <> ''").select("name", "target_doc", F.lit(0).alias("order")).unionByName(short)
    return every.groupBy("name").agg(F.min(F.struct("order", "target_doc")).alias("m")).select("name", F.col("m.target_doc").alias("target_doc"))


def labels(chunks: DataFrame) -> DataFrame:
    """(chunk_id, document_id, kind, ref, position): label references first, then sections, then § signs, in order of appearance.

    A reference named twice counts once, where it stands first.
    """
    t = F.coalesce(F.col("text"), F.lit(""))
    label = F.transform(F.arrays_zip(F.regexp_extract_all(t, F.lit(LABEL), F.lit(1)).alias("a"), F.regexp_extract_all(t, F.lit(LABEL), F.lit(2)).alias("b")), lambda m: F.struct(F.lit("exhibit").alias("kind"), F.concat_ws(" ", F.lower(m["a"]), F.lower(m["b"])).alias("ref")))
    section = F.transform(F.regexp_extract_all(t, F.lit(SECTION), F.lit(2)), lambda m: F.struct(F.lit("section").alias("kind"), F.concat(F.lit("section "), m).alias("ref")))
    sign = F.transform(F.regexp_extract_all(t, F.lit(SIGN), F.lit(1)), lambda m: F.struct(F.lit("section").alias("kind"), F.concat(F.lit("section "), m).alias("ref")))
    every = F.array_distinct(F.concat(label, section, sign))
    return chunks.select("chunk_id", "document_id", F.posexplode(every).alias("position", "r")).select("chunk_id", "document_id", "position", "r.kind", "r.ref")


def mentions(chunks: DataFrame, known: DataFrame) -> DataFrame:
    """(chunk_id, document_id, kind, ref, position, target_doc): names of other documents in a chunk's text, the longest first.

    A name of n words is met as a run of n words, so both joins are on equality: first the places where a name's
    first word stands, then the runs of those places that are a name.
    """
    usable = known.where((F.length("name") >= LEAST_NAME_CHARACTERS) | (F.size(F.split("name", " ")) >= LEAST_NAME_WORDS))
    usable = usable.select("name", "target_doc", F.split("name", " ")[0].alias("first"), F.size(F.split("name", " ")).alias("n"))
    starts = usable.groupBy("first").agg(F.collect_set("n").alias("sizes"))
    words = chunks.select("chunk_id", "document_id", F.filter(F.split(plain_words(F.col("text")), " "), lambda w: w != "").alias("ws"))
    places = words.select("chunk_id", "document_id", "ws", F.posexplode("ws").alias("i", "first"))
    longest = usable.agg(F.coalesce(F.max("n"), F.lit(1)).alias("longest"))  # words of the longest name
    tail = F.slice("ws", F.col("i") + 1, F.col("longest")).alias("tail")
    near = places.crossJoin(F.broadcast(longest)).select("chunk_id", "document_id", "first", tail).join(starts, "first")
    few = near.select("chunk_id", "document_id", "tail", F.explode("sizes").alias("n")).where(F.size("tail") >= F.col("n"))
    grams = few.select("chunk_id", "document_id", F.array_join(F.slice("tail", F.lit(1), F.col("n")), " ").alias("name")).distinct()
    found = grams.join(usable.select("name", "target_doc"), "name").where(~F.col("target_doc").eqNullSafe(F.col("document_id")) & ~F.coalesce(F.col("name") == plain_name(F.col("document_id")), F.lit(False)))
    order = Window.partitionBy("chunk_id", "document_id").orderBy(F.desc(F.length("name")), "name")
    return found.select("chunk_id", "document_id", F.lit("document").alias("kind"), F.col("name").alias("ref"), (F.row_number().over(order) - 1).alias("position"), "target_doc")


def resolve(references: DataFrame, known: DataFrame) -> DataFrame:
    """References with ``target_doc``: the document of exactly that name, else the one with the shortest name that has it as words.

    A reference to its own document has no target.  Distinct references are resolved, not rows; names are cut into
    their runs of words, so that both steps are joins on equality.
    """
    refs = references.select("ref").distinct().withColumn("k", F.trim(F.regexp_replace(F.lower("ref"), r"[^0-9a-z]+", " ")))
    ws = F.split("name", " ")
    spans = F.flatten(F.transform(F.sequence(F.lit(1), F.size(ws)), lambda i: F.transform(F.sequence(F.lit(1), F.size(ws) - i + 1), lambda n: F.array_join(F.slice(ws, i, n), " "))))
    parts = known.withColumn("k", F.explode(F.array_distinct(spans)))
    best = refs.join(parts, "k").groupBy("ref").agg(F.min(F.struct((F.col("name") != F.col("k")).alias("inside"), F.length("name").alias("length"), "name", "target_doc")).alias("b"))
    joined = references.join(best.select("ref", F.col("b.target_doc").alias("target_doc")), "ref", "left")
    return joined.withColumn("target_doc", F.when(~F.col("target_doc").eqNullSafe(F.col("document_id")), F.col("target_doc")))


def annotate(chunks: DataFrame) -> DataFrame:
    """(chunk_id, document_id, position, kind, ref, target_doc): at most eight references a chunk, labels before names.

    A document whose name was found as a label already is not named again.
    """
    known = names(chunks)
    found = resolve(labels(chunks), known)
    named = mentions(chunks, known).join(found.select("chunk_id", "document_id", "ref").distinct(), ["chunk_id", "document_id", "ref"], "left_anti")
    both = found.withColumn("group", F.lit(0)).unionByName(named.withColumn("group", F.lit(1)))
    order = Window.partitionBy("chunk_id", "document_id").orderBy("group", "position")
    return both.withColumn("position", F.row_number().over(order) - 1).where(F.col("position") < MOST_PER_CHUNK).select("chunk_id", "document_id", "position", "kind", "ref", "target_doc")


def statistics(references: DataFrame) -> DataFrame:
    """One row (chunks_with_refs, refs, resolved, target_docs)."""
    return references.agg(F.countDistinct("chunk_id").alias("chunks_with_refs"), F.count(F.lit(1)).alias("refs"), F.count("target_doc").alias("resolved"), F.countDistinct("target_doc").alias("target_docs"))


def link_degrees(references: DataFrame) -> DataFrame:
    """(document_id, out_degree, in_degree, degree) of the graph of resolved references, each link once."""
    edges = references.where("target_doc is not null and document_id is not null").select("document_id", "target_doc").distinct()
    out = edges.groupBy("document_id").agg(F.count(F.lit(1)).alias("out_degree"))
    into = edges.groupBy(F.col("target_doc").alias("document_id")).agg(F.count(F.lit(1)).alias("in_degree"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return out.join(into, "document_id", "full_outer").select("document_id", zero("out_degree"), zero("in_degree")).withColumn("degree", F.col("out_degree") + F.col("in_degree"))
