"""Community documents as text: rendering, the regions that are read back, and what is wrong with a document.

Everything is an expression over the lines of the text, so a table of
documents is checked like any other table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmesh.operators import community

#: The lines around the generated part and around the summary that is written by hand.
MARKS = ("<!-- generated:begin -->", "<!-- generated:end -->", "<!-- summary:begin -->", "<!-- summary:end -->")
KEYS = ("community", "topic", "built_from")


def document_text(docs: DataFrame) -> DataFrame:
    """layer, topic, cid, text of community documents (see ``community.documents``)."""
    rel = F.transform(F.split("relations", "\n"), lambda r: F.regexp_replace(r, r"^(.*) (\d+)$", "| $1 | $2 |"))
    table = F.when(F.col("relations") != "", F.concat(F.lit("| rel | edges |\n|---|---|\n"), F.array_join(rel, "\n"))).otherwise("(no relations inside)")
    text = F.concat(
        F.lit("---\ncommunity: "), "cid", F.lit("\ntopic: "), "topic", F.lit("\nbuilt_from: "), "built_from", F.lit(f"\n---\n\n{MARKS[0]}\n## Pages ("), F.col("n_members").cast("string"), F.lit(")\n\n"), "members",
        F.lit("\n\n## Relations inside\n\n"), table, F.lit(f"\n{MARKS[1]}\n\n{MARKS[2]}\n"), F.when(F.col("summary") != "", F.concat("summary", F.lit("\n"))).otherwise(""), F.lit(f"{MARKS[3]}\n"),
    )
    return docs.select("layer", "topic", "cid", text.alias("text"))


def _times(lines: Column, mark: str) -> Column:
    return F.size(F.filter(lines, lambda l: l == mark))


def regions(text: Column) -> Column:
    """struct(errors, community, topic, built_from, generated, summary) of a document.

    Each mark has to stand once, in order, and front matter with the three keys
    before; with an error the regions are null, so that nothing written by hand
    is taken from the wrong place.
    """
    lines = F.split(text, "\n")
    at = [F.array_position(lines, m) for m in MARKS]
    count = [_times(lines, m) for m in MARKS]
    once = [F.when(c != 1, F.concat(F.lit(f"{m} stands "), c.cast("string"), F.lit(" times"))) for m, c in zip(MARKS, count, strict=True)]
    every = (count[0] == 1) & (count[1] == 1) & (count[2] == 1) & (count[3] == 1)
    order = F.when(every & ~((at[0] < at[1]) & (at[1] < at[2]) & (at[2] < at[3])), F.lit("the marks are out of order"))
    end = F.when(F.get(lines, F.lit(0)) == "---", F.array_position(F.slice(lines, 2, 2**30), "---"))
    head = F.when(F.coalesce(end, F.lit(0)) > 0, F.slice(lines, F.lit(2), F.coalesce(end, F.lit(1)) - 1))
    value = lambda k: F.nullif(F.regexp_extract(F.array_join(head, "\n"), rf"(?m)^{k}: *(\S.*)$", 1), F.lit(""))
    faults = [F.when(head.isNull(), F.lit("no front matter"))]
    faults += [F.when(head.isNotNull() & value(k).isNull(), F.lit(f"{k} is missing")) for k in KEYS]
    other = F.size(F.filter(head, lambda l: ~l.rlike("^(" + "|".join(KEYS) + "):")))
    faults += [F.when(other > 0, F.concat(other.cast("string"), F.lit(" lines of front matter that are no key of a document")))]
    faults += [F.when(~value("built_from").rlike(r"^sha256:[0-9a-f]{64}\z"), F.lit("built_from is no hash"))]
    marks = F.array_compact(F.array(*once, order, F.when(head.isNull(), F.lit("no front matter"))))
    part = lambda a, b: F.when(F.size(marks) == 0, F.array_join(F.slice(lines, at[a] + 1, F.greatest(at[b] - at[a] - 1, F.lit(0))), "\n"))
    return F.struct(F.array_compact(F.array(*once, order, *faults)).alias("errors"), *[value(k).alias(k) for k in KEYS], part(0, 1).alias("generated"), part(2, 3).alias("summary"))


def format_issues(texts: DataFrame) -> DataFrame:
    """severity, code, target, message for each fault of documents (layer, topic, cid, text)."""
    r = texts.withColumn("r", regions(F.col("text")))
    wrong = F.array_compact(F.array(
        F.when(F.col("r.community") != F.col("cid"), F.lit("community is not that of the file")), F.when(F.col("r.topic") != F.col("topic"), F.lit("topic is not that of the folder")),
    ))
    each = r.select(F.concat_ws("/", "layer", "topic", "cid").alias("target"), F.explode(F.concat("r.errors", wrong)).alias("message"))
    return each.select(F.lit("error").alias("severity"), F.lit("community-format").alias("code"), "target", "message")


def kept_summaries(texts: DataFrame) -> DataFrame:
    """layer, topic, cid, summary: what was written by hand into documents that are in order."""
    return texts.select("layer", "topic", "cid", regions(F.col("text"))["summary"].alias("summary")).where("summary is not null and summary <> ''")


def of_ref(ref: str, assigned: DataFrame, texts: DataFrame, pages: DataFrame, topics: list[str] | None = None) -> DataFrame:
    """layer, cid, members, summary, stale: the community of one page; the project's, if both layers have the page.

    Stale: there is no document, or a member is gone or differs from what it
    was built from.  An error tells a topic that was not asked for, a topic
    without communities, and a page that came after they were built.
    """
    topic = ref.split("/")[0]
    if topics is not None and topic not in topics:
        raise ValueError(f"{topic} is not among the topics asked for")
    mine = assigned.where(F.col("topic") == topic)
    found = mine.where(F.col("ref") == ref).orderBy((F.col("layer") == "project").desc(), "layer").select("layer", "topic", "cid").limit(1)
    if found.isEmpty():
        raise LookupError(f"{ref} is in no community" if not mine.isEmpty() else f"no communities were built for {topic}")
    on = ["layer", "topic", "cid"]
    members = mine.join(found, on)
    now = community.set_hash(members.join(pages.select("layer", "ref", "hash"), ["layer", "ref"]), on)
    doc = texts.select(*on, regions(F.col("text")).alias("r")).select(*on, "r.built_from", "r.summary")
    named = members.groupBy(*on).agg(F.array_sort(F.collect_list("ref")).alias("members"))
    j = named.join(now, on, "left").join(doc, on, "left")
    return j.select("layer", "cid", "members", F.coalesce("summary", F.lit("")).alias("summary"), (~F.col("built_from").eqNullSafe(F.col("set_hash")) | F.col("built_from").isNull()).alias("stale"))
