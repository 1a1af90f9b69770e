"""Structured reports and what several models agree on."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arborlens.functions import fixed, paths
from arborlens.operators.ordering import assemble, number_rows

REPORT = (
    "struct<consultation:string,files_referenced:array<string>,"
    "key_concerns:array<string>,key_strengths:array<string>>"
)
LISTS = ("files_referenced", "key_concerns", "key_strengths")

# A block of the bundle has less than twice so many characters, whatever the number and length of texts and names.
BLOCK_CHARS = 4_000_000

_BUNDLE_TAIL = f"""
You are the editor of these reviews. Work claim by claim: note each claim with the file it is about and
the reviewers who make it, check it against the passages they quote, and leave out what nobody can
point to. Then write four parts.

## {fixed.SYNTHESIS_TITLES[0]}
Claims that stand on two reviewers or more. Give the place in the code first, then who saw it.

## {fixed.SYNTHESIS_TITLES[1]}
Places that several reviewers look at and judge differently: the cause, the weight or the remedy. Put their
readings side by side, each with its quotation, and name what a person would have to look up to decide.

## {fixed.SYNTHESIS_TITLES[2]}
Claims of one reviewer that their quotation bears out, and what would settle the rest.

## {fixed.SYNTHESIS_TITLES[3]}
A numbered list to work through: the change, the file, the claims behind it.

---

"""


#: What stands before, between and after model, text and model again.
_FRAME = ("=== CONSULTATION FROM: ", " ===\n\n", "\n\n=== END ", " ===\n")

# The text is parsed inside ``{"d":[[ ... ]]}``: the parser stops at the end of the first value, and
# the closing brackets, which no part of themselves can stand in for, make it see what follows.
_PARSED = (
    "struct<d:array<array<struct<consultation:variant,files_referenced:variant,"
    "key_concerns:variant,key_strengths:variant>>>>"
)


def parse_reports(rows: DataFrame, raw: Column, out: str = "report") -> DataFrame:
    """Add the JSON report in ``raw``, or NULL unless it is one value of the right shape.

    ``consultation`` must be a string. Each list may be absent (then it is empty) but must hold
    strings only; an explicit null is not a list. Other fields are ignored, and of a repeated field
    the last one counts. Each text is parsed once: the steps are columns of their own.
    """
    wrapped = F.concat(F.lit('{"d":[['), raw, F.lit("]]}"))
    inner = F.get("_json.d", 0)
    single = (F.size("_json.d") == 1) & (F.size(inner) == 1)

    def kind(field: str) -> Column:
        return F.schema_of_variant(f"_json.{field}")

    def texts(field: str) -> Column:
        listed = F.try_variant_get(F.col(f"_json.{field}"), "$", "array<string>")
        return F.when(F.col(f"_json.{field}").isNull(), F.array().cast("array<string>")).when(
            kind(field).isin("ARRAY<STRING>", "ARRAY<VOID>"), listed
        )

    valid = kind("consultation") == "STRING"
    for name in LISTS:
        # NULL for a value that is no list of strings; a null among the strings is seen here.
        valid = valid & F.coalesce(~F.exists(f"_{name}", F.isnull), F.lit(False))
    consultation = F.try_variant_get(F.col("_json.consultation"), "$", "string").alias("consultation")
    report = F.when(valid, F.struct(consultation, *[F.col(f"_{name}").alias(name) for name in LISTS]))
    return (
        rows.withColumn("_json", F.from_json(wrapped, _PARSED, {"allowSingleQuotes": "false"}))
        .withColumn("_json", F.when(single, F.get(inner, 0)))
        .withColumns({f"_{name}": texts(name) for name in LISTS})
        .withColumn(out, report.cast(REPORT))
        .drop("_json", *[f"_{name}" for name in LISTS])
    )


def with_reports(responses: DataFrame) -> DataFrame:
    """Parse the text of completed responses."""
    return parse_reports(responses, F.when(F.col("status") == "complete", F.col("raw_response")))


def mentions(reports: DataFrame, field: str, name: str) -> DataFrame:
    """Distinct ``(run_id, name, model)`` for one list of the reports.

    ``reports`` should be a written table: a test on a parsed column is pushed below the parsing.
    """
    items = reports.where("report IS NOT NULL").select(
        "run_id", "model", F.explode(f"report.{field}").alias(name)
    )
    return items.select("run_id", name, "model").distinct()


def file_mentions(reports: DataFrame) -> DataFrame:
    """How many models of a run refer to a file."""
    return (
        mentions(reports, "files_referenced", "file")
        .groupBy("run_id", "file")
        .agg(F.count(F.lit(1)).alias("n_models"))
    )


def consensus_findings(reports: DataFrame) -> DataFrame:
    """Concerns by the number of models that raise them: two or more converge, one is unique."""
    counted = mentions(reports, "key_concerns", "concern").groupBy("run_id", "concern").agg(
        F.count(F.lit(1)).alias("n_models")
    )
    converges = F.col("n_models") >= 2
    return counted.withColumns(
        {
            "verdict": F.when(converges, "convergent").otherwise("unique"),
            "confidence": F.when(converges, "high").otherwise("medium"),
        }
    )


def finding_models(reports: DataFrame) -> DataFrame:
    """Which models raise a concern, by name: ``(run_id, concern, pos, model)``."""
    raised = mentions(reports, "key_concerns", "concern")
    return number_rows(raised, ["run_id", "concern"], ["model"])


def agreement_matrix(reports: DataFrame, models: Sequence[str]) -> DataFrame:
    """Concern by model: one 0/1 column for each model of the list."""
    raised = mentions(reports, "key_concerns", "concern")
    return raised.groupBy("run_id", "concern").agg(
        *[F.count_if(F.col("model") == m).alias(matrix_column(m)) for m in models]
    )


def matrix_column(model: str) -> str:
    """Column name for a model."""
    return model.replace("/", "--")


def load_consultations(responses: DataFrame, completed_only: bool = False) -> DataFrame:
    """Texts of a run in the order of their file names: ``(run_id, pos, model, text, before, before_names)``.

    ``before`` and ``before_names`` are the characters that earlier framed texts and names take.

    Texts of failed models count unless ``completed_only``. Models whose file names coincide share
    one text, that of the last request (by ``pos``, if given). The order includes the ending of the
    file name: ``a-b.md`` comes before ``a.md``.
    """
    if completed_only:
        responses = responses.where("status = 'complete'")
    key = paths.model_key(F.col("model"))
    rank = F.struct("pos", "model") if "pos" in responses.columns else F.struct("model")
    files = responses.groupBy("run_id", F.concat(key, F.lit(".md")).alias("file")).agg(
        F.max_by(F.col("raw_response"), rank).alias("text")
    )
    model = paths.model_from_key(F.regexp_replace("file", r"\.md\z", ""))
    # Sizes are known before the texts move: a text with its frame, and a name with its comma.
    sizes = files.select(
        "run_id", "file",
        (F.coalesce(F.length("text"), F.lit(0)) + 2 * F.length(model) + sum(map(len, _FRAME)) + 1).alias("size"),
        (F.length(model) + 2).alias("name_size"),
    )
    numbered = number_rows(sizes, ["run_id"], ["file"], running={"before": "size", "before_names": "name_size"})
    return numbered.join(files, ["run_id", "file"]).select("run_id", "pos", model.alias("model"), "text", "before", "before_names")


def consultation_parts(consultations: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The bundle of a run as parts ``(run_id, section, block, item, text)``.

    Section 0 opens with the number of texts, section 1 lists the models, section 2 states the
    task, section 3 frames each text. Blocks are cut by size, and a text longer than a block into pieces.
    """
    zero = F.lit(0).cast("bigint")

    def part(section: int, block: Column, item: Column, value: Column) -> list[Column]:
        return [
            F.col("run_id"), F.lit(section).alias("section"), block.alias("block"),
            item.alias("item"), value.alias("text"),
        ]

    runs = consultations.groupBy("run_id").agg(F.count(F.lit(1)).alias("n"))
    opening = F.concat(F.lit("Synthesize "), F.col("n").cast("string"), F.lit(" code review consultations by: "))
    glue = F.when(F.col("pos") == 0, "").otherwise(", ")
    frame = F.concat(F.lit(_FRAME[0]), "model", F.lit(_FRAME[1]), "text", F.lit(_FRAME[2]), "model", F.lit(_FRAME[3]))
    # An empty line separates framed texts.
    newline = F.when(F.col("pos") == 0, "").otherwise("\n")

    def cut(value: Column, before: str) -> DataFrame:
        """Pieces of a value, none longer than a block, and the place where each begins."""
        whole = consultations.select("run_id", before, value.alias("_value"))
        start = F.explode(F.sequence(F.lit(0), F.greatest(F.length("_value") - 1, F.lit(0)), F.lit(block_chars)))
        pieces = whole.select("run_id", before, "_value", start.alias("_start"))
        return pieces.select(
            "run_id", (F.col(before) + F.col("_start")).alias("_at"), F.substring("_value", F.col("_start") + 1, F.lit(block_chars)).alias("_piece")
        )

    place = F.expr(f"_at div {block_chars}")
    return (
        runs.select(*part(0, zero, zero, opening))
        .unionByName(cut(F.concat(glue, "model"), "before_names").select(*part(1, place, F.col("_at"), F.col("_piece"))))
        .unionByName(runs.select(*part(2, zero, zero, F.lit("\n" + _BUNDLE_TAIL))))
        .unionByName(cut(F.concat(newline, frame), "before").select(*part(3, place, F.col("_at"), F.col("_piece"))))
    )


def consultation_bundle(consultations: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Blocks of the bundle of each run; the bundle is their concatenation in order."""
    return assemble(consultation_parts(consultations, block_chars), ["run_id", "section", "block"])
