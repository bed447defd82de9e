"""Text expressions: issue keys, case ids, tokens, fingerprints. All are built-in column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that each of the three tokenisers leaves out.
STOP_TITLES = (
    "a an the and or but for nor so yet at by from in into of off on onto out over to up with as is are was were be "
    "been being have has had do does did will would could should may might can that this it its not no if then when "
    "where which test tests testing verify verifies check checks validate validates ensure ensures complete completes "
    "update updates create creates new get set user users page pages flow flows step steps event events ui fix fixes"
).split()
STOP_CASES = (
    "a an the and or of to in on at by is are was be as it its for with that this from into then when not no can will "
    "do does have has had test evite verify confirm check ensure click view page user"
).split()
STOP_SUMMARIES = (
    "a an the and or of in on to for is are be can with from that this it as at by not no do does when if then user "
    "users should must will"
).split()
#: Prefixes of automated tests' names (the first that fits goes), and failures of infrastructure.
NAME_PREFIXES = ("test_evite_", "testevite", "test_", "test")
INFRA_FAILURES = (
    r"timed?\s*out", "ECONNREFUSED", "ECONNRESET", "ETIMEDOUT", "EHOSTUNREACH", r"network\s+error",
    r"worker\s+(crashed|killed|died)", r"browser\s+(closed|disconnected|crashed)", r"target\s+closed",
    r"page\s+closed", r"protocol\s+error", r"out\s+of\s+memory", r"spawn\s+\S+\s+ENOENT",
)
KEY = r"[A-Z][A-Z0-9]{1,9}-\d+"


def issue_keys(text: Column) -> Column:
    """Keys that no capital or digit precedes and no digit follows, in order, with repeats."""
    return F.regexp_extract_all(text, F.lit(rf"(?<![A-Z0-9])({KEY})(?!\d)"), 1)


def issue_keys_strict(text: Column) -> Column:
    """Distinct keys between word borders (an underscore is part of a word)."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(rf"\b({KEY})\b"), 1))


def case_ids(text: Column) -> Column:
    """Distinct numbers of C123, @C123 or TR-C123."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(r"(?:@|TR-)?[Cc](\d+)(?!\d)"), 1), lambda x: x.try_cast("long")))


def snippet(text: Column, key: Column, around: int = 20) -> Column:
    """The first place of key in text with what is around it."""
    at = F.position(key, text)
    start = F.greatest(at - around, F.lit(1))
    end = F.least(at + F.length(key) + around, F.length(text) + 1)
    return F.concat(F.when(start > 1, "…").otherwise(""), F.substring(text, start, end - start), F.when(end <= F.length(text), "…").otherwise(""))


def _kept(tokens: Column, stop: list[str], least: int = 2) -> Column:
    return F.array_distinct(F.filter(tokens, lambda t: (F.length(t) >= least) & ~t.isin(*stop)))


def title_tokens(text: Column) -> Column:
    """Words of a title: camel case is split, stop words and plain numbers are left out."""
    spaced = F.regexp_replace(F.regexp_replace(text, "([a-z])([A-Z])", "$1 $2"), "([A-Z]+)([A-Z][a-z])", "$1 $2")
    return F.filter(_kept(F.split(F.lower(spaced), "[^a-z0-9]+"), STOP_TITLES), lambda t: ~t.rlike(r"^\d+$"))


def case_tokens(text: Column) -> Column:
    """Words of a test's or case's title: of the part before the first dot without its prefix, and of the whole."""
    lower = F.lower(text)
    module = F.regexp_replace(F.substring_index(lower, ".", 1), "^(" + "|".join(NAME_PREFIXES) + ")", "")
    parts = F.concat(F.split(module, r"[\s_\-./]+"), F.split(lower, r"[\s_\-./]+"))
    return _kept(F.transform(parts, lambda t: F.regexp_replace(t, "[^a-z0-9]", "")), STOP_CASES)


def normal_title(text: Column) -> Column:
    """Lower case without a leading phrase such as 'verify that', letters and digits only, single spaces."""
    bare = F.regexp_replace(F.lower(text), r"^\s*(verify\s+that|test\s+that|ensure\s+that|check\s+that|should|it\s+should)\s+", "")
    return F.coalesce(F.trim(F.regexp_replace(F.regexp_replace(bare, r"[^a-z0-9\s]", " "), r"\s+", " ")), F.lit(""))


def summary_tokens(normal: Column) -> Column:
    return _kept(F.split(normal, r"\s+"), STOP_SUMMARIES)


def error_fingerprint(message: Column) -> Column:
    """16 hex digits that don't depend on line numbers and paths of test files."""
    bare = F.regexp_replace(F.regexp_replace(message, r"\d+:\d+", "0:0"), r"/[^\s]*\.(spec|test)\.(ts|js)", "<f>")
    return F.substring(F.sha2(bare, 256), 1, 16)


def is_infra(message: Column) -> Column:
    """Whether a failure looks like one of the infrastructure."""
    return message.rlike("(?i)" + "|".join(f"(?:{p})" for p in INFRA_FAILURES))


def seconds_to_ms(text: Column) -> Column:
    """Milliseconds of a text of seconds, half up; null if it isn't a finite number."""
    x = text.try_cast("double")
    return F.when(F.abs(x) < float("inf"), F.floor(x * 1000 + 0.5).cast("int"))


def split_test_id(test_id: Column) -> tuple[Column, Column]:
    """(file, title) of file::a > b > title."""
    return F.split_part(test_id, F.lit("::"), F.lit(1)), F.element_at(F.split(F.substring_index(test_id, "::", -1), " > "), -1)


def elapsed(ms: Column) -> Column:
    """1m 5s or 5s, rounded half up; null without a duration."""
    s = F.floor(ms / 1000 + 0.5)
    minutes = F.floor(s / 60)
    return F.when(minutes > 0, F.concat(minutes.cast("string"), F.lit("m "), (s % 60).cast("string"), F.lit("s"))).otherwise(F.concat(s.cast("string"), F.lit("s")))


def truncated(text: Column, most: int, mark: str = "") -> Column:
    """At most `most` characters, then the mark if something is cut."""
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit(mark))).otherwise(text)


def branch_name(ref: Column) -> Column:
    return F.regexp_replace(ref, "^origin/", "")


def run_name(job: Column, build: Column, run_id: Column, created: Column) -> Column:
    """job #12 — 2024-01-31, or the start of the run's id where it has no build."""
    return F.concat(F.coalesce(job, F.lit("playwright")), F.lit(" "), F.coalesce(F.concat(F.lit("#"), build.cast("string")), F.substring(run_id, 1, 8)), F.lit(" — "), F.date_format(created, "yyyy-MM-dd"))


def merged_env(base: Column, extra_json: Column) -> Column:
    """base (a map) with the entries of a JSON object, which win; text that isn't one is ignored."""
    extra = F.coalesce(F.from_json(extra_json, "map<string,string>"), F.create_map().cast("map<string,string>"))
    kept = F.map_filter(F.coalesce(base, F.create_map().cast("map<string,string>")), lambda k, v: ~F.array_contains(F.map_keys(extra), k))
    return F.map_concat(kept, extra)
