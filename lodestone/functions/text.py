"""Text functions as Column builders."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Every line boundary that text splitting knows, not only \n.
LINE_BREAK = "\\r\\n|[\\n\\x0B\\x0C\\r\\x1C\\x1D\\x1E\\x85\\u2028\\u2029]"
RARE_BREAK = "[\\x0B\\x0C\\r\\x1C\\x1D\\x1E\\x85\\u2028\\u2029]"
BREAKS = "\n\x0b\x0c\r\x1c\x1d\x1e\x85\u2028\u2029"
SPACE = "[\\s\\x1C-\\x1F\\x85\\xA0]"
SPACES = " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0"


def bound(value: Column, f) -> Column:
    """f(value) with value worked out once, however often f uses it."""
    return F.transform(F.array(value), f)[0]


def lit_array(values: list[str]) -> Column:
    return F.array(*(F.lit(v) for v in values)) if values else F.array().cast("array<string>")


def lines(text: Column) -> Column:
    """Lines without their breaks; a break at the end adds no empty line, and empty text has none."""
    ends = F.when(F.right(text, F.lit(2)) == "\r\n", 2).when(F.right(text, F.lit(1)).isin(*BREAKS), 1).otherwise(0)
    body = F.left(text, F.length(text) - ends)
    parts = F.when(text.rlike(RARE_BREAK), F.split(body, LINE_BREAK)).otherwise(F.split(body, "\n"))  # a regular expression only where it is needed
    return F.when(F.length(text) == 0, F.array().cast("array<string>")).otherwise(parts)


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(SPACES))


def rstrip(text: Column) -> Column:
    return F.rtrim(text, F.lit(SPACES))


def words(text: Column) -> Column:
    return F.filter(F.split(text, f"{SPACE}+"), lambda w: w != "")


def tokens_v1(text: Column) -> Column:
    """A quarter of the code points, one at least."""
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4).cast("int"))


def tokens_v2(text: Column) -> Column:
    """A third of the code points, rounded up, one at least."""
    return F.greatest(F.lit(1), F.floor((F.length(text) + 2) / 3).cast("int"))


def truncate(text: Column, limit: int) -> Column:
    return bound(strip(text), lambda t: F.when(F.length(t) <= limit, t).otherwise(F.concat(rstrip(F.substring(t, 1, limit - 3)), F.lit("..."))))


def word_budget(budget: int, backend: str = "deterministic") -> int:
    least, share = {"llama.cpp": (10, 7), "vllm": (12, 6), "sglang": (12, 6)}.get(backend, (8, 8))
    return max(least, budget // share)


def compress(text: Column, budget: int = 384, backend: str = "deterministic") -> Column:
    """The first words of the budget, 220 code points at most."""
    return truncate(F.array_join(F.slice(words(text), 1, word_budget(budget, backend)), " "), 220)


def query_terms(query: str, extra: list[str] | None = None) -> list[str]:
    """Terms of a query for the substring strategies; repeats stay and count again."""
    import re

    found = re.findall(r"[A-Za-z0-9_./:-]+", query.lower()) + [x.lower() for x in extra or []]
    return [t for t in found if len(t) > 1]


def query_terms_column(query: Column) -> Column:
    return F.filter(F.regexp_extract_all(F.lower(query), F.lit("([a-z0-9_./:-]+)"), 1), lambda t: F.length(t) > 1)


def identifier_pieces(value: Column) -> Column:
    """Parts of snake and camel case names, lower case, two characters at least."""
    spaced = F.regexp_replace(F.regexp_replace(value, "([a-z0-9])([A-Z])", "$1 $2"), "([A-Z]+)([A-Z][a-z])", "$1 $2")
    return F.transform(F.filter(F.split(spaced, "[^A-Za-z0-9]+"), lambda p: F.length(p) >= 2), lambda p: F.lower(p))


def occurrences(text: Column, term: Column) -> Column:
    """Non-overlapping occurrences of a term of one character or more."""
    return ((F.length(text) - F.length(F.replace(text, term, F.lit("")))) / F.length(term)).cast("long")


def times_contained(text: Column, terms: list[str]) -> Column:
    """How many of the terms, repeats included, the text contains."""
    return reduce(lambda a, b: a + b, (F.contains(text, F.lit(t)).cast("int") for t in terms), F.lit(0))


def any_contained(text: Column, terms: list[str]) -> Column:
    return reduce(lambda a, b: a | b, (F.contains(text, F.lit(t)) for t in terms), F.lit(False))


def first_match(text: Column, rules: list[tuple[str, str]], otherwise: Column) -> Column:
    """The value of the first needle that the text contains."""
    out = otherwise
    for needle, value in reversed(rules):
        out = F.when(F.contains(text, F.lit(needle)), F.lit(value)).otherwise(out)
    return out


def first_sentence(text: Column) -> Column:
    """Up to the first ". ", else "! ", else "? ": by that order, not by place; 240 code points."""

    def cut(flat: Column) -> Column:
        out = F.substring(flat, 1, 240)
        for sep in ("? ", "! ", ". "):
            out = F.when(F.contains(flat, F.lit(sep)), F.concat(F.substring(F.substring_index(flat, sep, 1), 1, 240), F.lit(sep.strip()))).otherwise(out)
        return out

    return bound(F.array_join(words(text), " "), cut)


def filled_lines(ls: Column) -> Column:
    """Lines that hold more than white space, stripped."""
    return F.filter(F.transform(ls, strip), lambda x: x != "")


def key_points(ls: Column) -> Column:
    """Five bullets at most, else the first three filled lines; 240 code points each."""

    def pick(filled: Column) -> Column:
        bullets = F.filter(filled, lambda x: x.rlike("^(-|\\*|[123]\\.)"))
        return F.when(F.size(bullets) > 0, F.slice(bullets, 1, 5)).otherwise(F.slice(filled, 1, 3))

    return bound(F.transform(filled_lines(ls), lambda x: F.substring(x, 1, 240)), pick)


def redact_line(line: Column) -> Column:
    """From the first known token in this order on, the rest of a line is hidden."""
    out = line
    for token in ("api_key=", "apikey=", "token=", "bearer ", "Bearer "):
        out = F.when(F.contains(line, F.lit(token)), F.concat(F.substring_index(line, token, 1), F.lit(token + "[REDACTED]"))).otherwise(out)
    return out


def redact_log(text: Column) -> Column:
    """Values after bearer, token= and api key= are hidden, whatever their case."""
    for pattern in (r"(?i)(bearer\s+)([A-Za-z0-9._-]+)", r"(?i)(token=)([^&\s]+)", r"(?i)(api[_-]?key=)([^&\s]+)"):
        text = F.regexp_replace(text, pattern, "$1[REDACTED]")
    return text


def truncate_bytes(text: Column, most: int, suffix: str = "\n[TRUNCATED]\n") -> Column:
    """UTF-8 bytes, cut so that they and the suffix are most bytes."""
    data = F.encode(text, "UTF-8")
    end = suffix.encode()
    cut = F.lit(end[:most]) if most <= len(end) else F.concat(F.substring(data, 1, most - len(end)), F.lit(end))
    return F.when(F.octet_length(text) <= most, data).otherwise(cut)


def interesting(line: Column) -> Column:
    return F.lower(line).rlike("error|failed|exception|fatal|undefined")


def detect_symbol(ls: Column) -> Column:
    """The name that the first line starting with func, def or class declares."""
    found = F.filter(F.transform(ls, strip), lambda x: x.rlike("^(func|def|class) "))
    first = F.coalesce(F.try_element_at(found, F.lit(1)), F.lit(""))
    name = F.when(first.startswith("class "), F.replace(F.substring_index(first, ":", 1), F.lit("class "), F.lit(""))).when(first.startswith("func "), F.replace(F.substring_index(first, "(", 1), F.lit("func "), F.lit(""))).otherwise(F.replace(F.substring_index(first, "(", 1), F.lit("def "), F.lit("")))
    return strip(name)
