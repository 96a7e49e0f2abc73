"""Evidence strings: their tags, and whether the quotes stand in the study's text.

Quotes meet their text in lists: a text is moved and prepared once for every QUOTES_TOGETHER quotes of its study, however many
there are, and not once a quote.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veriquill.functions.arrow import hint_quotes, locate_quotes, nearest_wordings, quote_windows
from veriquill.functions.columns import BLANKS, json_kind, shortened, tag_texts, tags_flat

#: A quote with one of these may be more than one fragment.
ELIDED = r"\.{3}|…"
#: Quotes of a study that share one copy of its text.
QUOTES_TOGETHER = 256


def quote_rows(cells: DataFrame) -> DataFrame:
    """(study_id, path, at, quote) of every quote in well-formed evidence."""
    fine = cells.where(F.col("evidence").isNotNull() & tags_flat(F.col("evidence")))
    return fine.select("study_id", "path", F.posexplode(tag_texts(F.col("evidence"), "q")).alias("at", "quote"))


def with_texts(quotes: DataFrame, papers: DataFrame) -> DataFrame:
    """(study_id, rows, text): lists of quote rows, as structs, with their study's text, null if there is none.

    Both sides are shuffled once, by study; the lists are cut and gathered in place.
    """
    numbered = quotes.withColumn("__list", F.floor((F.row_number().over(Window.partitionBy("study_id").orderBy("quote")) - 1) / QUOTES_TOGETHER))
    lists = numbered.groupBy("study_id", "__list").agg(F.collect_list(F.struct(*[F.col(f"`{c}`") for c in quotes.columns])).alias("rows"))
    return lists.join(papers.select("study_id", "text"), "study_id", "left").select("study_id", "rows", "text")


def _trimmed(quote: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(quote, r"(?U)^\s+", ""), r"(?U)\s+$", "")


def located(quotes: DataFrame, papers: DataFrame, hints: bool = False) -> DataFrame:
    """quotes (study_id, quote, ...) with `found`: matched, reading, tier, start, end, parts; with hints also nearest and reordered.

    A quote of one fragment that stands in a text without page breaks as written is settled in the JVM; only the others
    cross to Python. Positions are code points, from 0, end exclusive. Of a lost quote, `nearest` is the text's nearest
    wording and `reordered` says that all its fragments stand there, but in another order.
    """
    text, kind = F.col("text"), hint_quotes if hints else locate_quotes
    broken = F.lower(text).contains("page break")

    def settled(row: Column) -> Column:
        quote = _trimmed(row["quote"])
        at = F.instr(text, quote)
        start, end = (at - 1).cast("long").alias("start"), (at - 1 + F.length(quote)).cast("long").alias("end")
        part = F.struct(quote.alias("fragment"), F.lit("literal").alias("reading"), F.lit("direct").alias("tier"), start, end)
        more = [F.lit(None).cast("string").alias("nearest"), F.lit(False).alias("reordered")] if hints else []
        found = F.struct(F.lit(True).alias("matched"), F.lit("literal").alias("reading"), F.lit("direct").alias("tier"), start, end, F.array(part).alias("parts"), *more)
        return F.when((quote != "") & ~quote.rlike(ELIDED) & ~broken & (at > 0), found)

    both = with_texts(quotes, papers).withColumn("plain", F.transform("rows", settled))
    hard = F.transform(F.arrays_zip("rows", "plain"), lambda z: F.when(z["plain"].isNull(), z["rows"]["quote"]))
    both = both.withColumn("hard", kind(hard, text))
    told = both.select(F.inline(F.arrays_zip("rows", "plain", "hard")))
    return told.select(*[F.col(f"rows.`{c}`") for c in quotes.columns], F.coalesce("plain", "hard").alias("found"))


def nearest(quotes: DataFrame, papers: DataFrame) -> DataFrame:
    """quotes with `nearest`: the text's own words nearest to the first fragment that stands nowhere."""
    both = with_texts(quotes, papers)
    told = both.withColumn("nearest", nearest_wordings(F.transform("rows", lambda r: r["quote"]), F.col("text"))).select(F.inline(F.arrays_zip("rows", "nearest")))
    return told.select(*[F.col(f"rows.`{c}`") for c in quotes.columns], "nearest")


def windows(quotes: DataFrame, papers: DataFrame, budget: int) -> DataFrame:
    """quotes with start, end and text of each window of `budget` characters around their fragments, quoted spans marked."""
    both = with_texts(quotes, papers)
    told = both.withColumn("windows", quote_windows(budget)(F.transform("rows", lambda r: r["quote"]), F.col("text"))).select(F.inline(F.arrays_zip("rows", "windows")))
    return told.select(*[F.col(f"rows.`{c}`") for c in quotes.columns], F.explode("windows").alias("w")).select(*[f"`{c}`" for c in quotes.columns], "w.start", "w.end", "w.text")


def judged(cells: DataFrame, papers: DataFrame, labels: DataFrame, required: bool = True) -> DataFrame:
    """(study_id, cell, path, code, message, quote, tier): what is wrong with each cell's evidence, and, without a code, its weak matches.

    cells as from `values.checked`; labels: study_id, label. Tags that do not pair hide all else. Quotes are looked up
    whatever the value is; the rule that a value needs a quote or an image only asks whether there is one, blank or not.
    With required=False (values from people) no evidence is owed. Every quote is located once.
    """
    nothing = F.lit(None).cast("string")
    row = lambda path, code, message, quote=nothing, tier=nothing: ["study_id", F.col("path").alias("cell"), path.alias("path"), code.alias("code"), message.alias("message"), quote.alias("quote"), tier.alias("tier")]
    paired = tags_flat(F.col("evidence"))
    here = F.concat("path", F.lit(".evidence"))
    bad = cells.where(F.col("evidence").isNotNull() & ~paired).select(*row(here, F.lit("malformed_tags"), F.lit("quote and image tags must open and close side by side, none inside another")))
    fine = cells.where(F.col("evidence").isNull() | paired)
    quotes, blank = quote_rows(cells), F.regexp_replace("quote", BLANKS, "") == ""
    where = F.format_string("%s.evidence[<q>%d]", "path", "at")
    empty = quotes.where(blank).select(*row(where, F.lit("empty_quote"), F.format_string("quote %d holds no text", F.col("at") + 1)))
    found = located(quotes.where(~blank), papers, hints=True)
    lost = ~F.col("found.matched")
    hint = F.when(F.col("found.reordered"), "; all its parts stand there, but in another order").when(F.col("found.nearest").isNotNull(), F.concat(F.lit("; the nearest wording is: "), "found.nearest")).otherwise("")
    message = F.concat(F.lit("the text has no such words: "), shortened(F.col("quote")), hint)
    weak = F.col("found.tier") == "case_folded"
    said = found.where(lost | weak).select(*row(where, F.when(lost, "quote_not_in_text"), F.when(lost, message), shortened(F.col("quote")), F.col("found.tier")))
    form = lambda c: F.lower(F.trim(F.regexp_replace(c, r"(?U)^\s+|\s+$", "")))
    images = fine.select("study_id", "path", F.posexplode(tag_texts(F.col("evidence"), "img")).alias("at", "image")).withColumn("form", form(F.col("image")))
    there = F.format_string("%s.evidence[<img>%d]", "path", "at")
    no_label = images.where("form = ''").select(*row(there, F.lit("empty_image_label"), F.format_string("image %d has no label", F.col("at") + 1)))
    known = labels.select("study_id", form(F.col("label")).alias("form")).distinct()
    unknown = images.where("form <> ''").join(known, ["study_id", "form"], "left_anti").select(*row(there, F.lit("unknown_image_label"), F.concat(F.lit("the study has no exhibit called "), F.trim("image"))))
    count = F.size(tag_texts(F.coalesce("evidence", F.lit("")), "q")) + F.size(tag_texts(F.coalesce("evidence", F.lit("")), "img"))
    owed = F.lit(required) & F.coalesce(F.col("evidence_rule") == "required", F.lit(False)) & (json_kind(F.col("value_out")) != "null") & (count == 0)
    lacking = fine.where(owed).select(*row(here, F.lit("evidence_required"), F.concat(F.lit("a value of "), "variable", F.lit(" needs a quote or an image"))))
    return bad.unionByName(empty).unionByName(said).unionByName(no_label).unionByName(unknown).unionByName(lacking)


def evidence_problems(cells: DataFrame, papers: DataFrame, labels: DataFrame, required: bool = True) -> DataFrame:
    """(study_id, path, code, message) of `judged`."""
    return judged(cells, papers, labels, required).where("code is not null").select("study_id", "path", "code", "message")


def weak_matches(cells: DataFrame, papers: DataFrame) -> DataFrame:
    """Quotes that stand in the text only with case folded."""
    found = located(quote_rows(cells), papers).where("found.tier = 'case_folded'")
    return found.select("study_id", F.format_string("%s.evidence[<q>%d]", "path", "at").alias("path"), shortened(F.col("quote")).alias("quote"), "found.tier")
