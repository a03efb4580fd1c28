"""Shares of applications by what a scan found in them: set algebra on bits.

An application's memberships are bits of one number, the or of its findings' bits.
Unions, intersections and differences are masks on it, so all shares come from one
small grouping: applications by whether they are integrated and by their bits.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textquarry import rules
from textquarry.functions import scalars as S
from textquarry.operators import corpus

CREDENTIAL, OTHER_SECRET, SYSTEM_PROMPT, PRESET, TOOL_SCHEMA, RAG, ENDPOINT, OUTSIDE_DEX = (1 << k for k in range(8))
#: What an application shows without a server's help.
ARTEFACT = CREDENTIAL | SYSTEM_PROMPT | TOOL_SCHEMA | RAG
#: A credential of provider k sets bit FIRST_PROVIDER + k too.
FIRST_PROVIDER = 8
GENERIC = "generic"
#: A provider whose identifiers name more than inference services.
AMBIGUOUS = "aws_bedrock"


def provider_mask(*providers: str) -> int:
    return sum(1 << FIRST_PROVIDER + rules.PROVIDERS.index(p) for p in providers)


def finding_bits() -> Column:
    """The bits of one finding (kind, provider, evidence, file_path)."""
    kind, provider = F.col("kind"), F.coalesce("provider", F.lit(GENERIC))
    credential = (kind == "secret") & (provider != GENERIC)
    register = S.classify_prompt(F.col("evidence"))["class"]
    tests = {
        CREDENTIAL: credential, OTHER_SECRET: (kind == "secret") & ~credential, SYSTEM_PROMPT: (kind == "system_prompt") & (register == "system_prompt"), PRESET: (kind == "system_prompt") & (register == "preset"),
        TOOL_SCHEMA: kind == "tool_schema", RAG: kind == "rag_artefact", ENDPOINT: kind == "llm_endpoint", OUTSIDE_DEX: S.not_dex(F.col("file_path")),
    }
    known = F.array_position(F.array(*map(F.lit, rules.PROVIDERS)), provider)
    own = F.when(credential & (known > 0), F.call_function("shiftleft", F.lit(1).cast("bigint"), (known + (FIRST_PROVIDER - 1)).cast("int"))).otherwise(F.lit(0).cast("bigint"))
    return reduce(Column.bitwiseOR, [F.when(test, F.lit(bit)).otherwise(F.lit(0)).cast("bigint") for bit, test in tests.items()], own)


def memberships(findings: DataFrame, integration: DataFrame, scanned: DataFrame) -> DataFrame:
    """One row for each scanned application (app_id): confirmed and bits. scan() gives findings and integration."""
    bits = findings.groupBy("app_id").agg(F.bit_or(finding_bits()).alias("bits"))
    flags = integration.select("app_id", "confirmed")
    return scanned.select("app_id").distinct().join(bits, "app_id", "left").join(flags, "app_id", "left").select("app_id", F.coalesce("confirmed", F.lit(False)).alias("confirmed"), F.coalesce("bits", F.lit(0)).cast("bigint").alias("bits"))


def grouped(apps: DataFrame) -> DataFrame:
    """Applications counted by their memberships; as many rows as combinations occur."""
    return apps.groupBy("confirmed", "bits").agg(F.count("*").alias("apps"))


def any_of(mask: int) -> Column:
    return F.col("bits").bitwiseAND(F.lit(mask).cast("bigint")) != 0


def all_of(mask: int) -> Column:
    return F.col("bits").bitwiseAND(F.lit(mask).cast("bigint")) == mask


PROVIDER_BITS = provider_mask(*rules.PROVIDERS)


def only(provider: str) -> Column:
    """Credentials of this provider and of no other."""
    return F.col("bits").bitwiseAND(F.lit(PROVIDER_BITS).cast("bigint")) == provider_mask(provider)


def _count(test: Column) -> Column:
    return F.coalesce(F.sum(F.when(test, F.col("apps"))), F.lit(0))


def _shares(one: DataFrame, rows: list[tuple[str, Column, Column]]) -> DataFrame:
    """(category, successes, n) with intervals from one row of counts; shares and bounds keep four digits."""
    listed = F.explode(F.array(*[F.struct(F.lit(name).alias("category"), k.cast("bigint").alias("successes"), n.cast("bigint").alias("n")) for name, k, n in rows]))
    out = corpus.with_interval(one.select(listed.alias("r")).select("r.*"), "unit")
    four = {c: S.round_exact(F.col(c)) for c in ("proportion", "ci_lower", "ci_upper")}
    return out.withColumn("ci_width", S.round_exact(F.col("ci_upper") - F.col("ci_lower"))).withColumns(four)


def named_sets() -> dict[str, Column]:
    """The sets whose shares are reported; any_artefact is a union, no_artefact what is left of the integrated ones without it."""
    return {
        "inference_credential": any_of(CREDENTIAL), "other_secret": any_of(OTHER_SECRET), "system_prompt": any_of(SYSTEM_PROMPT), "preset_only": any_of(PRESET) & ~any_of(SYSTEM_PROMPT), "tool_schema": any_of(TOOL_SCHEMA),
        "rag_artefact": any_of(RAG), "llm_endpoint": any_of(ENDPOINT), "any_artefact": any_of(ARTEFACT), "no_artefact": ~any_of(ARTEFACT), "finding_outside_dex": any_of(OUTSIDE_DEX),
    }


def prevalence(apps: DataFrame) -> DataFrame:
    """Ten shares of the integrated applications."""
    sets, inside = named_sets(), F.col("confirmed")
    one = grouped(apps).agg(_count(inside).alias("n"), *[_count(inside & test).alias(name) for name, test in sets.items()])
    return _shares(one, [(name, F.col(name), F.col("n")) for name in sets])


def sensitivity(apps: DataFrame) -> DataFrame:
    """How shares change if applications that were not confirmed count too when they hold a credential of a provider, unless it is the ambiguous one's alone."""
    inside = F.col("confirmed")
    attributed = ~inside & any_of(PROVIDER_BITS)
    one = grouped(apps).agg(
        F.coalesce(F.sum("apps"), F.lit(0)).alias("scanned"), _count(inside).alias("n"), _count(attributed).alias("attributed"), _count(attributed & only(AMBIGUOUS)).alias("ambiguous"),
        _count(inside & any_of(CREDENTIAL)).alias("credential"), _count(inside & any_of(ARTEFACT)).alias("artefact"),
    )
    missed = F.col("attributed") - F.col("ambiguous")
    widened = F.col("n") + missed
    return _shares(one, [
        ("rejected_with_provider_credential", F.col("attributed"), F.col("scanned") - F.col("n")), ("ambiguous_only", F.col("ambiguous"), F.col("scanned") - F.col("n")), ("unambiguous_credential", missed, F.col("scanned") - F.col("n")),
        ("integration", widened, F.col("scanned")), ("inference_credential", F.col("credential") + missed, widened), ("any_artefact", F.col("artefact") + missed, widened),
    ])


def co_occurrence(apps: DataFrame, first: int = CREDENTIAL, second: int = SYSTEM_PROMPT) -> DataFrame:
    """Of the integrated applications in the first set, those in the second too; no share without any."""
    inside = F.col("confirmed")
    one = grouped(apps).agg(_count(inside & any_of(first)).alias("first"), _count(inside & all_of(first | second)).alias("both"))
    return one.withColumn("share", S.round_exact(F.try_divide("both", "first")))
