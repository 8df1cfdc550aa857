r"""URL filter: pattern rules indexed by their rarest literal token.

Pattern rules come in the syntax of public filter lists: ``||`` stands for the start of the host or
of one of its labels, ``|`` for the start or end, ``*`` for anything, ``^`` for a separator (no
letter, digit or one of ``_-.%``) or the end, ``/.../`` holds a regular expression, ``@@`` allows,
``!`` begins a comment.  A rule's literal tokens (runs of ASCII letters and digits) are derived from
the pattern: those that no URL can lengthen on either side, so that each match contains them whole.
The corpus counts how often these tokens occur in URLs, and a rule is filed under its rarest one.  A
URL's own tokens then fetch the few rules that can match it, and only those run.

List rules (host suffix and path prefix) decide first, the longest one that fits; where none fits,
the pattern rules decide over the lower-cased host and path (an allowing one wins), and where none of
these matches the URL is allowed.

Defined results: a null URL or one without ``://`` has an empty host and path; of equally long
list rules the blocking one wins; texts of any length are matched whole; repeated rows give repeated
results; an empty table an empty one.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hitweave.llm import url_rules

TOKEN = re.compile(r"[A-Za-z0-9]+")

# Verdict, host and path of the list rules.
LIST_RULES = [
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
]


@dataclass(frozen=True)
class Rule:
    pattern: str
    tokens: tuple[str, ...]
    verdict: str
    name: str | None = None  # list rules only
    whole_case: bool = False


def list_rule(verdict: str, host: str, path: str) -> Rule:
    """A rule for a host with its subdomains and for paths that start with ``path``."""
    # A token counts if nothing in the URL can lengthen it: not at the open end of the path.
    tokens = TOKEN.findall(host.lower()) + [m[0].lower() for m in TOKEN.finditer(path) if m.end() < len(path)]
    return Rule(rf"\A(?:[^/]*\.)?{re.escape(host)}{re.escape(path)}", tuple(tokens), verdict, host + path, True)


def _pieces(pattern: str) -> list[str]:
    """A filter pattern in pieces: ``||`` and ``|`` at the edges, ``*``, ``^``, tokens, and single other characters."""
    head = "||" if pattern.startswith("||") else "|" if pattern.startswith("|") else ""
    tail = "|" if len(pattern) > len(head) and pattern.endswith("|") else ""
    body = pattern[len(head) : len(pattern) - len(tail)]
    return [head, *re.findall(r"[a-z0-9]+|.", body, re.S), tail]


def parse(line: str) -> Rule | None:
    """The rule of a line of a filter list; None for a comment or an empty line."""
    line = line.strip()
    if not line or line.startswith("!"):
        return None
    verdict = "allow" if line.startswith("@@") else "block"
    line = line.removeprefix("@@").lower()
    if len(line) > 2 and line.startswith("/") and line.endswith("/"):
        return Rule(line[1:-1], (), verdict)  # what it contains whole isn't known
    pieces = _pieces(line)
    regex = {"||": r"\A(?:[^/]*\.)?", "|": r"\A", "": ""}[pieces[0]]
    tokens = []
    for i, piece in enumerate(pieces[1:-1], 1):
        if piece == "*":
            regex += "(?s:.*)"
        elif piece == "^":
            regex += r"(?:[^a-z0-9_.%-]|\z)"
        else:
            regex += re.escape(piece)
            # nothing before or after a token may lengthen it: an edge that is open, or "*", may
            if TOKEN.fullmatch(piece) and pieces[i - 1] not in ("", "*") and pieces[i + 1] not in ("", "*"):
                tokens.append(piece)
    return Rule(regex + (r"\z" if pieces[-1] else ""), tuple(dict.fromkeys(tokens)), verdict)


def default_rules() -> list[Rule]:
    return [list_rule(*r) for r in LIST_RULES] + [r for line in url_rules.lines() if (r := parse(line))]


def compiled(pattern: str) -> re.Pattern:
    """The pattern for Python, whose sign for the end is another."""
    return re.compile(pattern.replace(r"\z", r"\Z"))


class Index:
    """The rules under their rarest tokens; those without any are always run."""

    def __init__(self, rules: list[Rule], frequency: dict[str, int]):
        self.rules = [(r, compiled(r.pattern)) for r in rules]
        self.under: dict[str, list[int]] = {}
        self.always = []
        for i, rule in enumerate(rules):
            if rule.tokens:
                self.under.setdefault(min(rule.tokens, key=lambda t: (frequency.get(t, 0), t)), []).append(i)
            else:
                self.always.append(i)

    def candidates(self, text: str) -> list[int]:
        own = {t for t in TOKEN.findall(text)} & self.under.keys()
        return sorted([*self.always, *(i for t in own for i in self.under[t])])

    def judge(self, host: str, path: str) -> tuple[str | None, str]:
        """(list rule, verdict)."""
        exact = host + path
        lower = exact.lower()
        best, found = None, set()
        for i in self.candidates(lower):
            rule, pattern = self.rules[i]
            if not pattern.search(exact if rule.whole_case else lower):
                continue
            if rule.name is None:
                found.add(rule.verdict)
            elif best is None or (len(rule.name), rule.verdict == "block") > (len(best.name), best.verdict == "block"):
                best = rule
        if best:
            return best.name, best.verdict
        return None, "block" if found == {"block"} else "allow"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL, both empty without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    raw = F.regexp_extract(rest, "^[^/?#]*", 0)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(raw, upper, upper.lower()), F.regexp_extract(F.substr(rest, F.char_length(raw) + 1), "^[^?#]*", 0)


def token_frequency(urls: DataFrame, tokens: set[str]) -> dict[str, int]:
    """How often the rules' tokens occur over all rows of ``urls`` (one string column)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()
        for batch in batches:
            for url in batch.column(0).to_pylist():
                seen.update(tokens.intersection(TOKEN.findall((url or "").lower())))
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["token", "n"])

    return {t: n for t, n in urls.mapInArrow(run, "token string, n long").groupBy("token").agg(F.sum("n")).collect()}


def filter_urls(df: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: list[Rule] | None = None) -> DataFrame:
    """Columns id_col, host, path, rule, verdict for every row."""
    rules = default_rules() if rules is None else rules
    urls = F.coalesce(F.col(f"`{url_col}`"), F.lit(""))
    host, path = host_and_path(urls)
    index = Index(rules, token_frequency(df.select(urls.alias("url")), {t for r in rules for t in r.tokens}))
    schema = f"`{id_col}` {df.schema[id_col].dataType.simpleString()}, host string, path string, rule string, verdict string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            judged = [index.judge(*p) for p in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            cols = [pa.array([j[i] for j in judged], pa.string()) for i in range(2)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *cols], names=[id_col, "host", "path", "rule", "verdict"])

    return df.select(F.col(f"`{id_col}`"), host.alias("host"), path.alias("path")).mapInArrow(run, schema)
