"""The text that a checker is asked with, field by field. The wording is our own; what each part says, and when it is left out, is not."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veriquill.functions.columns import SENTENCES, json_string, tag_texts
from veriquill.operators.runs import shown_value

NO_IDENTITY = "(nothing is known of the study's identity)"
NO_EVIDENCE = "(no evidence was given)"
SLOTS = ("field_path", "field_description", "extraction_instruction_block", "allowed_values_block", "identity_context", "evidence_block", "value", "notes_block")


def _some(text: Column) -> Column:
    return F.nullif(F.trim(F.coalesce(text, F.lit(""))), F.lit(""))


def instruction_block(instruction: Column) -> Column:
    return F.coalesce(F.concat(F.lit("\n_How it is extracted_: "), _some(instruction)), F.lit(""))


def allowed_block(field_type: Column, options: Column, allow_other: Column, reference: Column, value: Column) -> Column:
    """What the field may hold: its options, open or closed, the list its names come from, or its type.

    Of an open list it is said whether the value is one of the options; a value from a list is spelled right already.
    """
    listed = F.array_join(options, " | ")
    open_list = F.concat(listed, F.lit(" | Other (specify)"))
    chosen = F.coalesce(F.array_contains(options, json_string(value)), F.lit(False))
    return (
        F.when((F.size(options) > 0) & allow_other & chosen, F.concat(F.lit("_Allowed values_ (an open list; the value is one of it, so judge the choice): "), open_list))
        .when((F.size(options) > 0) & allow_other, F.concat(F.lit("_Usual values_ (an open list; the value is not one of it, which is allowed, unless one of these fits better): "), open_list))
        .when(F.size(options) > 0, F.concat(F.lit("_Allowed values_: "), listed))
        .when(reference.isNotNull() & (field_type == "string_list"), F.concat(F.lit("_Type_: names from the list "), reference, F.lit(", spelled as there; judge whether the evidence bears out these names")))
        .when(reference.isNotNull(), F.concat(F.lit("_Allowed values_: a name from the list "), reference, F.lit(", spelled as there")))
        .when(field_type.isNotNull(), F.concat(F.lit("_Type_: "), field_type))
        .otherwise("")
    )


def notes_block(notes: Column) -> Column:
    """The extractor's own note on the field, said to be no evidence; nothing if there is none."""
    return F.coalesce(F.concat(F.lit("\n## The extractor's note\n\nAn explanation of the value, not evidence for it.\n\n"), _some(notes)), F.lit(""))


def evidence_block(evidence: Column) -> Column:
    """The quotes and images of an evidence string; its prose is withheld. Without tags all of it is one quote."""
    tagged = evidence.contains("<q>") | evidence.contains("<img>")
    quotes = F.when(tagged, tag_texts(evidence, "q")).otherwise(F.array(evidence))
    images = F.when(tagged, F.transform(tag_texts(evidence, "img"), lambda x: F.trim(x))).otherwise(F.array().cast("array<string>"))
    one = F.concat(F.lit('"'), quotes[0], F.lit('"'))
    many = F.concat(F.lit("The paper's words:\n"), F.array_join(F.transform(quotes, lambda q, i: F.concat(F.lit("  "), (i + 1).cast("string"), F.lit('. "'), q, F.lit('"'))), "\n"))
    shown = F.when(F.size(quotes) == 1, one).when(F.size(quotes) > 1, many)
    exhibits = F.when(F.size(images) > 0, F.concat(F.lit("Shown in: "), F.array_join(images, ", ")))
    return F.when(_some(evidence).isNull(), NO_EVIDENCE).otherwise(F.coalesce(F.nullif(F.concat_ws("\n", shown, exhibits), F.lit("")), F.lit(NO_EVIDENCE)))


def messages(cells: DataFrame, template: str) -> DataFrame:
    """cells with `message`: the template with its slots filled.

    cells: path, description, extraction_instruction, field_type, options, allow_other, canonical_reference, value, evidence,
    notes, identity. The slots are filled in the order of SLOTS; what a value holds is filled in after what asks for it.
    """
    fill = {
        "field_path": F.col("path"),
        "field_description": F.coalesce(_some(F.col("description")), F.lit("")),
        "extraction_instruction_block": instruction_block(F.col("extraction_instruction")),
        "allowed_values_block": allowed_block(F.col("field_type"), F.col("options"), F.coalesce("allow_other", F.lit(False)), F.col("canonical_reference"), F.col("value")),
        "identity_context": F.coalesce(_some(F.col("identity")), F.lit(NO_IDENTITY)),
        "evidence_block": evidence_block(F.col("evidence")),
        "value": shown_value(F.col("value")),
        "notes_block": notes_block(F.col("notes")),
    }
    text = F.lit(template)
    for slot in SLOTS:
        text = F.replace(text, F.lit("{" + slot + "}"), fill[slot])
    return cells.withColumn("message", text)


def event_sentence(event: Column, message: Column) -> Column:
    """What an event of a run says to a reader, with its own message if it has one; null for events that need no sentence."""
    said = F.create_map(*[F.lit(x) for pair in SENTENCES.items() for x in pair])[event]
    return F.when(said.isNotNull(), F.concat_ws(" ", said, _some(message)))
