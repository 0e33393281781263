"""Checks of a model's structured answers: shape, limits and defaults, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The limits and words of the answer formats.
LEVELS = ("HIGH", "MEDIUM", "LOW")
VERDICTS = ("approve", "comment", "request_changes")
CONFIDENCE = ("CONFIRMED", "LIKELY", "POSSIBLE", "INSUFFICIENT_CONTEXT")
ACTIONS = ("modify", "create")
FINDINGS, FILES = 25, 6

REVIEW = "summary string, verdict string, riskLevel string, findings array<struct<severity:string,confidence:string,category:string,filePath:string,line:int,title:string,issue:string,recommendation:string>>, testGaps array<string>, breakingChanges array<string>"
CHANGE = "summary string, reasoning string, files array<struct<path:string,action:string,newContent:string,edits:array<struct<startLine:int,endLine:int,replacement:string>>,rationale:string>>, warnings array<string>, callersToReview array<string>, testSuggestion string"
OVERVIEW = "summary string, architecture string, entryPoints array<string>, importantDirectories array<struct<path:string,purpose:string>>, frameworks array<string>, databases array<string>"


def _text(c: Column, most: int, least: int = 0) -> Column:
    """A required text of least to most characters."""
    return F.coalesce(F.length(c).between(least, most), F.lit(False))


def _maybe(c: Column, most: int) -> Column:
    return F.coalesce(F.length(c) <= most, F.lit(True))


def _one_of(c: Column, words: tuple[str, ...]) -> Column:
    return F.coalesce(c.isin(*words), F.lit(False))


def _texts(c: Column, each: int, most: int) -> Column:
    """A list that may be missing, of texts that may not."""
    return F.coalesce((F.size(c) <= most) & F.forall(c, lambda x: _text(x, each)), F.lit(True))


def _all(c: Column, most: int, test) -> Column:
    """A required list of at most `most` items that pass."""
    return F.coalesce((F.size(c) <= most) & F.forall(c, test), F.lit(False)) & c.isNotNull()


def _first(**broken: Column) -> Column:
    """The name of the first broken field, null where all hold."""
    return F.coalesce(*[F.when(~ok, F.lit(name)) for name, ok in broken.items()])


def review_fault(a: Column) -> Column:
    """The first field of a review (struct of REVIEW) that breaks its format, or null; null for no answer is `json`."""
    finding = lambda f: _one_of(f["severity"], LEVELS) & _one_of(f["confidence"], CONFIDENCE) & _maybe(f["category"], 60) & _maybe(f["filePath"], 400) & F.coalesce(f["line"] >= 0, F.lit(True)) & _text(f["title"], 160) & _text(f["issue"], 1200) & _text(f["recommendation"], 1200)
    return F.when(a.isNull(), "json").otherwise(_first(
        summary=_text(a["summary"], 1500, 1), verdict=_one_of(a["verdict"], VERDICTS), riskLevel=_one_of(a["riskLevel"], LEVELS),
        findings=_all(a["findings"], FINDINGS, finding), testGaps=_texts(a["testGaps"], 300, 10), breakingChanges=_texts(a["breakingChanges"], 300, 10),
    ))


def change_fault(a: Column) -> Column:
    """As review_fault, for a proposed change (struct of CHANGE)."""
    edit = lambda e: F.coalesce((e["startLine"] >= 1) & (e["endLine"] >= 1), F.lit(False)) & e["replacement"].isNotNull()
    file = lambda f: _text(f["path"], 400, 1) & (f["action"].isNull() | _one_of(f["action"], ACTIONS)) & (f["edits"].isNull() | F.coalesce(F.forall(f["edits"], edit), F.lit(True))) & _maybe(f["rationale"], 600)
    return F.when(a.isNull(), "json").otherwise(_first(
        summary=_text(a["summary"], 500, 1), reasoning=_maybe(a["reasoning"], 2000), files=_all(a["files"], FILES, file), warnings=_texts(a["warnings"], 300, 10),
        callersToReview=_texts(a["callersToReview"], 200, 20), testSuggestion=_maybe(a["testSuggestion"], 800),
    ))


def overview_fault(a: Column) -> Column:
    """As review_fault, for a repository overview (struct of OVERVIEW)."""
    place = lambda d: _maybe(d["path"], 300) & _maybe(d["purpose"], 300)
    directories = a["importantDirectories"].isNull() | _all(a["importantDirectories"], 14, place)
    return F.when(a.isNull(), "json").otherwise(_first(
        summary=_text(a["summary"], 2000), architecture=_maybe(a["architecture"], 2500), entryPoints=_texts(a["entryPoints"], 300, 12), importantDirectories=directories,
        frameworks=_texts(a["frameworks"], 80, 20), databases=_texts(a["databases"], 80, 10),
    ))


def parsed(answer: Column, schema: str) -> Column:
    """The answer as a struct; a field of another type counts as missing, a text that isn't an object as null."""
    return F.when(F.ltrim(answer).startswith("{"), F.from_json(answer, schema))


def review_defaults(a: Column) -> Column:
    """A valid review with its defaults in place of what is missing."""
    none = F.array().cast("array<string>")
    finding = lambda f: f.withField("category", F.coalesce(f["category"], F.lit("correctness"))).withField("filePath", F.coalesce(f["filePath"], F.lit(""))).withField("line", F.coalesce(f["line"], F.lit(0)))
    return a.withField("findings", F.transform(a["findings"], finding)).withField("testGaps", F.coalesce(a["testGaps"], none)).withField("breakingChanges", F.coalesce(a["breakingChanges"], none))
