"""Secret scans through an inverted index of trigrams.

From each rule's regular expression a Boolean trigram query is derived: its finite stretches (literals, alternatives,
optional characters) give alternatives of strings, each string the conjunction of its trigrams; stretches that must all
occur are clauses joined by AND. The index holds a posting (trigram, document) for each trigram that some query names,
over lower-cased texts. Postings are intersected per document, and only documents that satisfy a rule's query
are verified by its expression. A rule without a mandatory trigram scans every text.

Matches are leftmost and non-overlapping per rule; one whose measured group is too short is dropped after matching.
Offsets count code points, the end is exclusive.

Defined cases: a null text counts as empty; a document is known by its id (null allowed) and its text, so repeated rows
get the same result each; an empty table gives an empty result; columns other than id and text are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from re import _constants as sre
from re import _parser as sre_parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pointlens.llm.common import checkpoint


@dataclass(frozen=True)
class Rule:
    """pattern: one that Java and Python read alike, in lower case where ignore_case is set. group, least: a match counts if that group has so many characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    ignore_case: bool = False
    base: bool = False

    @property
    def java(self) -> str:
        return ("(?i)" if self.ignore_case else "") + self.pattern


#: The three base kinds in the order that breaks ties, then token formats that their issuers publish.
RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", group=2, least=6, ignore_case=True, base=True),
    Rule("access", r"AKIA[A-Z0-9]+", least=20, base=True),
    Rule("hex", r"[0-9a-f]{24,}", base=True),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("private_key", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----"),
)

_MOST_STRINGS = 64


def _strings(items, start: set[str]) -> tuple[list[set[str]], set[str]]:
    """Walk a parsed expression. start: what may stand directly before. Returns closed stretches and the open one."""
    closed, now = [], start
    for op, arg in items:
        if op is sre.LITERAL:
            now = {s + chr(arg).lower() for s in now}
        elif op is sre.SUBPATTERN:
            more, now = _strings(arg[3], now)
            closed += more
        elif op is sre.BRANCH:
            ends = [_strings(branch, {""}) for branch in arg[1]]
            if any(more for more, _ in ends):  # a branch that isn't a finite set of strings
                closed.append(now)
                now = {""}
            else:
                now = {s + e for s in now for _, end in ends for e in end}
        elif op is sre.IN and all(kind is sre.LITERAL for kind, _ in arg):
            now = {s + chr(c).lower() for s in now for _, c in arg}
        elif op is sre.MAX_REPEAT and arg[1] == 1:
            more, once = _strings(arg[2], {""})
            if more:
                closed.append(now)
                now = {""}
            else:
                now = now | {s + o for s in now for o in once}
        else:
            closed.append(now)
            now = {""}
        if len(now) > _MOST_STRINGS:
            closed.append(now)
            now = {""}
    return closed, now


def trigram_query(pattern: str) -> list[list[list[str]]]:
    """AND of clauses, each an OR of alternatives, each an AND of trigrams; empty if no trigram is mandatory.

    >>> trigram_query("AKIA[A-Z0-9]+")
    [[['aki', 'kia']]]
    """
    closed, last = _strings(sre_parser.parse(pattern), {""})
    clauses = []
    for stretch in [*closed, last]:
        if min(map(len, stretch)) >= 3:
            clauses.append(sorted({tuple(dict.fromkeys(s[i : i + 3] for i in range(len(s) - 2))) for s in stretch}))
    return [[list(alternative) for alternative in clause] for clause in clauses]


def postings(docs: DataFrame, trigrams: list[str]) -> DataFrame:
    """The inverted index: trigram, _id, _hash for each of the given trigrams that a document has."""
    low = docs.select("_id", "_hash", F.lower("_text").alias("_low"))
    held = F.array_compact(F.array(*[F.when(F.contains("_low", F.lit(t)), F.lit(t)) for t in trigrams]))
    return low.select("_id", "_hash", F.explode(held).alias("trigram"))


def candidates(index: DataFrame, queries: dict[str, list[list[list[str]]]]) -> DataFrame:
    """_id, _hash, _kinds: the rules whose query a document's postings satisfy. A document has at most as many postings as there are trigrams."""
    found = index.groupBy("_id", "_hash").agg(F.collect_set("trigram").alias("_found"))
    has = lambda alternative: reduce(Column.__and__, [F.array_contains("_found", t) for t in alternative])
    holds = lambda query: reduce(Column.__and__, [reduce(Column.__or__, map(has, clause)) for clause in query])
    kinds = F.array_compact(F.array(*[F.when(holds(q), F.lit(kind)) for kind, q in queries.items()]))
    return found.select(F.col("_id").alias("_c_id"), F.col("_hash").alias("_c_hash"), kinds.alias("_kinds")).where(F.size("_kinds") > 0)


def _sql(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _bound(name: str, value: str, body: str) -> str:
    """SQL: body with a name for a value that is computed once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


_EMPTY = "cast(array() AS array<struct<s: int, k: int, e: int>>)"


def _spans(rule: Rule, number: int) -> str:
    """SQL: the rule's spans in _text, as an array of (s, k, e).

    The pieces between matches and the matches themselves add up to the offsets. Sums over n matches are taken in about root of n blocks of as
    many, since an array that grows is copied at each step.
    """
    p = _sql(rule.java)
    steps = f"""
        zip_with(
          slice(split(_text, {p}, -1), 1, size(regexp_extract_all(_text, {p}, 0))),
          zip_with(regexp_extract_all(_text, {p}, 0), regexp_extract_all(_text, {p}, {rule.group}), (h, m) -> named_struct('hit', length(h), 'measured', length(m))),
          (p, x) -> named_struct('gap', length(p), 'hit', x.hit, 'measured', x.measured))"""
    width = "cast(ceil(sqrt(size(steps))) AS int)"
    blocks = f"transform(sequence(0, cast((size(steps) - 1) div {width} AS int)), b -> slice(steps, b * {width} + 1, {width}))"
    total = "aggregate(block, 0, (a, x) -> a + x.gap + x.hit)"
    starts = f"aggregate(blocks, array(0), (a, block) -> array_append(a, element_at(a, -1) + {total}))"
    ends = "slice(aggregate(block, array(start), (a, x) -> array_append(a, element_at(a, -1) + x.gap + x.hit)), 2, size(block))"
    marked = f"zip_with(block, {ends}, (x, e) -> named_struct('s', e - x.hit, 'k', {number}, 'e', e, 'measured', x.measured))"
    all_spans = f"flatten(zip_with(blocks, slice({starts}, 1, size(blocks)), (block, start) -> {marked}))"
    good = f"transform(filter({all_spans}, x -> x.measured >= {rule.least}), x -> named_struct('s', x.s, 'k', x.k, 'e', x.e))"
    return f"CASE WHEN rlike(_text, {p}) THEN {_bound('steps', steps, _bound('blocks', blocks, good))} ELSE {_EMPTY} END"


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, spans: array of (s, k, e) by start, then rule; k is the rule's place in `rules`."""
    keyed = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text")).withColumn("_hash", F.xxhash64("_text"))
    queries = {r.kind: q for r in rules if (q := trigram_query(r.pattern))}
    trigrams = sorted({t for q in queries.values() for clause in q for alternative in clause for t in alternative})
    if queries:
        index = checkpoint(postings(keyed, trigrams))
        hits = checkpoint(candidates(index, queries))  # a table of its own, so that Spark can split a document that is repeated often
        keyed = keyed.join(hits, F.col("_id").eqNullSafe(F.col("_c_id")) & (F.col("_hash") == F.col("_c_hash")), "left")
    arrays = []
    for number, rule in enumerate(rules):
        spans = _spans(rule, number)
        if rule.kind in queries:
            spans = f"CASE WHEN coalesce(array_contains(_kinds, '{rule.kind}'), false) THEN {spans} ELSE {_EMPTY} END"
        arrays.append(F.expr(spans))
    return keyed.select(F.col("_id").alias(id_col), F.array_sort(F.concat(*arrays)).alias("spans"))


def digest(found: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id") -> DataFrame:
    """The counts of the base kinds, the digest of their spans and all spans as text."""
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    line = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(kinds, x.k), x.s.cast("string"), x.e.cast("string"))), ",")
    of_kind = lambda i: lambda x: x.k == i
    is_base = lambda x: x.k.isin([i for i, r in enumerate(rules) if r.base])
    return found.select(
        id_col,
        *[F.size(F.filter("spans", of_kind(i))).cast("long").alias(f"n_{r.kind}") for i, r in enumerate(rules) if r.base],
        F.sha2(line(F.filter("spans", is_base)), 256).alias("base_sha256"),
        line(F.col("spans")).alias("spans"),
    )


def _oracle() -> str:
    """DuckDB: the digest, from plain regular expressions over every text."""
    both = lambda word: "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)
    lists = []
    for number, rule in enumerate(RULES):
        p = rule.pattern
        if rule.ignore_case:
            for word in ("password", "passwd", "secret", "token", "api_?key"):
                p = p.replace(word, both(word), 1)
        p = "'" + p.replace("'", "''") + "'"
        lists.append(
            f"""SELECT doc_id, {number} AS k, '{rule.kind}' AS kind, regexp_extract_all(t, {p}) AS hits,
                regexp_extract_all(t, {p}, {rule.group}) AS measured, string_split_regex(t, {p}) AS pieces, {rule.least} AS least FROM texts"""
        )
    return f"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
found AS ({" UNION ALL ".join(lists)}),
numbered AS (SELECT *, unnest(range(1, len(hits) + 1)) AS i FROM found WHERE len(hits) > 0),
placed AS (
  SELECT doc_id, k, kind, length(measured[i]) >= least AS good, length(hits[i]) AS n,
         CAST(list_sum(list_transform(pieces[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS s
  FROM numbered),
spans AS (SELECT doc_id, k, s, kind || ':' || s || ':' || (s + n) AS span FROM placed WHERE good),
each AS (
  SELECT doc_id, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex,
         string_agg(span, ',' ORDER BY s, k) FILTER (k < 3) AS base, string_agg(span, ',' ORDER BY s, k) AS spans
  FROM spans GROUP BY doc_id)
SELECT d.doc_id, coalesce(e.n_assign, 0) AS n_assign, coalesce(e.n_access, 0) AS n_access, coalesce(e.n_hex, 0) AS n_hex,
       sha256(coalesce(e.base, '')) AS base_sha256, coalesce(e.spans, '') AS spans
FROM documents d LEFT JOIN each e ON d.doc_id = e.doc_id
"""


ORACLE_SQL = _oracle()
