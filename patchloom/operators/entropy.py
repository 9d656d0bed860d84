"""High-entropy values assigned to names that hint at credentials."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import globs
from ..functions import text as T
from ..sources.rules import Rule

RULE = Rule(
    id="secret.high-entropy-string", title="High-entropy value under a credential-like name", category="secrets", severity="high", confidence="low", on="added", paths=("**",), patterns=(".",), redact=True,
    question="What does this value open, and who could have copied it from here?",
    guidance="Look up where the value is accepted. If anything accepts it, replace it there before touching this line.\n\nEncoded data and test values score as high as keys do: note on the line what it is, and the finding is suppressed.",
    cwe=("CWE-798",),
)
MIN_ENTROPY, MIN_LENGTH = 3.6, 20

#: What an assignment looks like, which names hint at a credential, and which values and paths do not count.
ASSIGNMENT = r"""([A-Za-z_][A-Za-z0-9_.\-]{2,40})[\t\n\f\r ]*[:=][\t\n\f\r ]*(?:"([^"\t\n\f\r ]{8,200})"|'([^'\t\n\f\r ]{8,200})'|`([^`\t\n\f\r ]{8,200})`|([A-Za-z0-9+/=_\-]{8,200}))"""
NAMES = r"(?iu)(secret|token|key|passw|pwd|credential|auth|api|access|private|signature|sign|salt|cert|session|cookie|bearer|client_?id|nonce|seed)"
PLACEHOLDERS = r"(?iu)^(\$\{|\{\{|%\(|<%|process\.env|os\.environ|env\[|ENV\[|null|none|true|false|undefined|changeme|placeholder|redacted|example|sample|dummy|your[_\-]|xxx+|test|fake|todo|fixme|\*+|\.\.\.)"
STRUCTURAL = r"(?iu)^(https?://|/|\./|\.\./|[a-z]+\.[a-z]+\.[a-z]+$|#[0-9a-f]{3,8}$|[0-9]+(\.[0-9]+)+$|[0-9]+$)"
NOISY = [
    "**/*.lock", "**/*.sum", "**/package-lock.json", "**/yarn.lock", "**/pnpm-lock.yaml", "**/Gemfile.lock", "**/poetry.lock", "**/composer.lock", "**/*.min.js", "**/*.min.css", "**/*.map",
    "**/*.snap", "**/*.svg", "**/*.ipynb", "**/testdata/**", "**/fixtures/**", "**/__snapshots__/**", "**/vendor/**", "**/node_modules/**", "**/*.po", "**/*.mo",
]


def candidates(lines: DataFrame, min_length: int = MIN_LENGTH) -> DataFrame:
    """``lines`` whose first assignment gives a value worth measuring: with name and value."""
    # A generator keeps what it makes: later filters cannot be moved below it, so the pattern runs once over a line that has
    # a sign of assignment, and once more over the short text it matched to give both groups.
    once = lambda c, name: F.explode(F.array(c)).alias(name)
    signed = lines.where(F.contains("text", F.lit("=")) | F.contains("text", F.lit(":")))
    met = signed.select("*", once(F.regexp_extract("text", ASSIGNMENT, 0), "_met")).where("_met <> ''")
    both = F.split(F.regexp_replace("_met", ASSIGNMENT, "$1\u0001$2$3$4$5"), "\u0001", 2)
    found = met.select("*", once(both, "_both")).withColumns({"name": F.get("_both", F.lit(0)), "value": F.nullif(F.get("_both", F.lit(1)), F.lit(""))}).drop("_met", "_both")
    plausible = (F.octet_length("value") >= min_length) & F.col("name").rlike(NAMES) & ~F.col("value").rlike(PLACEHOLDERS) & ~F.col("value").rlike(STRUCTURAL)
    return found.where(plausible & (F.length(F.regexp_replace("value", "[^/]", "")) <= 2) & ~F.contains("value", F.lit(" ")))


def hits(lines: DataFrame, min_entropy: float = MIN_ENTROPY, min_length: int = MIN_LENGTH, exclude_paths: list[str] = ()) -> DataFrame:
    """Added lines of paths that are not noisy whose value is random enough: with name, value and match."""
    lines = lines.where((F.col("kind") == "added") & ~globs.any_of(F.col("path"), [*NOISY, *exclude_paths]))
    found = candidates(lines, min_length).where((T.entropy(F.col("value")) >= min_entropy) & T.mixed(F.col("value")))
    return found.withColumn("match", F.col("value"))
