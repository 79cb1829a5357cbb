"""Personal data by weak supervision, in DataFrame and SQL functions only.

Candidates are what the patterns below find; a base pattern's valid matches are personal data as
they are, the other patterns add looser forms. Four labelers vote -1, 0 or 1 on each candidate:
its form (regex), lists of endings, issuers and prefixes (gazetteer), cue words before it
(context) and the signs beside it (boundary). Votes are counted over the whole corpus. Expectation-
maximisation on the counts estimates each labeler's reliability and each vote pattern's
probability; a logistic classifier of votes, form and length is trained on these and decides on the
looser candidates. Both work on the table of vote patterns, which has at most ``6 * 81 * 8`` rows
whatever the corpus, so they are plain arithmetic on the driver; finding, voting and deciding run
in Spark expressions.

A text is parted at the matches of a pattern; positions are running sums of the parts' lengths.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

common.shipped(__name__)

#: The first four have base patterns.
KINDS = ("email", "ip", "card", "phone", "secret")
BASE_KINDS = 4
#: Least probability at which a looser candidate counts.
ACCEPTED = 0.9
#: Matches that are summed at a time, and code points of a piece; keep the work on a long text linear.
CHUNK, PIECE = 128, 256


@dataclass(frozen=True)
class Pattern:
    """regex finds what the stated pattern finds, in linear time: a match begins where a run of its first class begins or the last match ended."""

    kind: int
    base: bool
    regex: str
    guard: str
    valid: str
    form: str
    listed: str
    cue: str


_EMAIL_ENDS = "com|org|net|edu|gov|info|io|co|uk|de|fr|es|it|nl|eu"
_NAMED = "(?:[Tt]oken|TOKEN|[Ss]ecret|SECRET|[Pp]assword|PASSWORD|[Pp]asswd|[Pp]wd|[Kk]ey|KEY)"
_OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
#: Order: base patterns by kind, then looser forms. Votes are SQL on m (match); cue is a pattern for what stands before.
PATTERNS = (
    Pattern(
        0,
        True,
        r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
        "contains(text, '@')",
        "true",
        r"if(m rlike r'^[A-Za-z0-9].*\.[A-Za-z]{2,}$', 1, -1)",
        rf"if(lower(m) rlike r'\.(?:{_EMAIL_ENDS})$', 1, 0)",
        r"e-?mail|mail|contact|write|reach|correo|courriel",
    ),
    Pattern(
        1,
        True,
        r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
        r"text rlike r'[0-9]\.[0-9]'",
        rf"m rlike r'^{_OCTET}(?:\.{_OCTET}){{3}}$'",
        r"if(m rlike r'^[1-9][0-9]{0,2}(?:\.(?:0|[1-9][0-9]{0,2})){3}$', 1, -1)",
        r"if(m rlike r'^(?:10|127|172|192)\.', 1, 0)",
        r"\bip\b|host|server|addr|login|from",
    ),
    Pattern(
        2,
        True,
        r"[0-9](?:[ -]?[0-9])++",
        "text rlike r'[0-9][ -]?[0-9]'",
        "length(translate(m, ' -', '')) between 13 and 19 and luhn_check(translate(m, ' -', ''))",
        "if(m rlike r'^[0-9]{4}([ -]?)[0-9]{4,6}(?:[ -]?[0-9]{4,5}){1,2}$', 1, 0)",
        "if(m rlike r'^(?:4|5[1-5]|2[2-7]|3[47]|35|6011|65)', 1, -1)",
        r"card|visa|master|amex|credit|karte|carte|tarjeta|pay",
    ),
    Pattern(
        3,
        True,
        r"\+[0-9][ ().0-9-]+[0-9]",
        "contains(text, '+')",
        "length(regexp_replace(m, '[^0-9]', '')) between 9 and 15",
        "if(length(regexp_replace(m, '[^0-9]', '')) between 10 and 13, 1, 0)",
        r"if(m rlike r'^\+(?:1|7|20|27|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])', 1, 0)",
        r"phone|tel|call|mobile|fax|cell|whatsapp|anruf|appel|llam",
    ),
    Pattern(
        0,
        False,
        r"[A-Za-z0-9._%+-]{1,64}+ ?(?:\[at\]|\(at\)) ?[A-Za-z0-9-]{1,63}+(?: ?(?:\.|\[dot\]|\(dot\)) ?[A-Za-z0-9-]{1,63}+)++",
        r"text rlike r'[\[(]at[\])]'",
        "true",
        r"if(m rlike r'^[A-Za-z0-9].*[A-Za-z]{2,}$', 1, -1)",
        rf"if(lower(m) rlike r'(?:\.|\]|\)) ?(?:{_EMAIL_ENDS})$', 1, -1)",
        r"e-?mail|mail|contact|write|reach|correo|courriel",
    ),
    Pattern(
        3,
        False,
        r"(?<![0-9.+-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])",
        r"text rlike r'[0-9]{3}[ .-][0-9]{4}'",
        "true",
        r"if(m rlike r'^\(|^[0-9]{3}(-|\.)[0-9]{3}\1', 1, 0)",
        r"if(m rlike r'^\(?[2-9]', 1, -1)",
        r"phone|tel|call|mobile|fax|cell|whatsapp|anruf|appel|llam",
    ),
    Pattern(
        4,
        False,
        rf"(?<=[ :=\x27\x22])(?<={_NAMED}[\x27\x22]{{0,1}} {{0,1}}[:=] {{0,1}}[\x27\x22]{{0,1}})[A-Za-z0-9+/_.=-]{{16,}}+",
        rf"text rlike r'[:=](?<={_NAMED}[\x27\x22]{{0,1}} {{0,1}}[:=])'",
        "true",
        "if(m rlike '[0-9]' and m rlike '[A-Za-z]', 1, -1)",
        "if(m rlike '^(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{64})$', 1, 0)",
        r"token|secret|passw|pwd|key|auth",
    ),
    Pattern(
        4,
        False,
        r"(?<![A-Za-z0-9])(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36,}+|xox[abprs]-[A-Za-z0-9-]{10,}+|sk[_-][A-Za-z0-9_-]{20,}+|AIza[A-Za-z0-9_-]{35}|eyJ[A-Za-z0-9_-]{10,}+\.[A-Za-z0-9_-]{10,}+\.[A-Za-z0-9_-]{5,}+)",
        " or ".join(f"contains(text, '{x}')" for x in ("AKIA", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "xox", "sk_", "sk-", "AIza", "eyJ")),
        "true",
        "if(m rlike '[0-9]' and m rlike '[A-Za-z]', 1, -1)",
        "if(m rlike '^(?:AKIA|gh|xox|AIza|eyJ)', 1, 0)",
        r"token|secret|passw|pwd|key|auth|bearer",
    ),
)
LABELERS = 4


def _let(value: str, name: str, body: str) -> str:
    """body with name bound to value, which is evaluated once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _sums(array: str, tag: str) -> str:
    """Running sums, each step copying what it has."""
    return f"aggregate({array}, cast(array() as array<bigint>), (a{tag}, v{tag}) -> array_append(a{tag}, coalesce(try_element_at(a{tag}, -1), 0L) + v{tag}))"


def _running(array: str) -> str:
    """Running sums of an array of longs, in chunks."""
    chunks = f"transform(sequence(0, greatest(0, size(xs) - 1) div {CHUNK}), c -> {_sums(f'slice(xs, c * {CHUNK} + 1, {CHUNK})', '1')})"
    ends = _sums("transform(cs, t -> coalesce(try_element_at(t, -1), 0L))", "2")
    return _let(array, "xs", _let(chunks, "cs", _let(ends, "es", "flatten(transform(cs, (g, i) -> transform(g, y -> y + if(i = 0, 0L, es[i - 1]))))")))


def _candidates(p: Pattern, number: int) -> str:
    """Array of the valid matches of text: k, begin, stop, base and what the classifier sees."""
    parts = f"named_struct('p', split(text, r'{p.regex}', -1), 'm', regexp_extract_all(text, r'{p.regex}', 0))"
    ends = _running("transform(z.m, (m, i) -> cast(length(z.p[i]) + length(m) as bigint))")
    return f"if({p.guard}, {_let(parts, 'z', _let(ends, 'ends', _each(p, number)))}, {_none()})"


def _each(p: Pattern, number: int) -> str:
    seen = f"named_struct('k', {p.kind}, 'begin', ends[i] - length(m), 'stop', ends[i], 'base', {str(p.base).lower()}, {_features(p, number, 'z.p[i]', 'z.p[i + 1]')})"
    return f"filter(transform(z.m, (m, i) -> if({p.valid}, {seen}, null)), x -> x is not null)"


def _features(p: Pattern, number: int, before: str, after: str) -> str:
    context = f"case when right({before}, 1) rlike '[A-Za-z0-9]' then -1 when lower(right({before}, 32)) rlike r'{p.cue}' then 1 else 0 end"
    return f"'n', {number}, 'v1', {p.form}, 'v2', {p.listed}, 'v3', {context}, 'v4', if({after} rlike '^[A-Za-z0-9_]', -1, 1), 'size', least(3, length(m) div 8), 'parted', if(m rlike '[ ()-]', 1, 0)"


def _none() -> str:
    return "cast(array() as array<struct<k: int, begin: bigint, stop: bigint, base: boolean, n: int, v1: int, v2: int, v3: int, v4: int, size: int, parted: int>>)"


SEEN = ("n", "v1", "v2", "v3", "v4", "size", "parted")


def _clear(kind: int) -> str:
    """SQL: whether x touches no base span of a kind, whose spans are in order and apart: the last that begins before x stops is found by halving."""
    nth = f"aggregate(sequence(30, 0, -1), 0, (lo, s) -> if(get(b{kind}, lo + shiftleft(1, s) - 1).begin < x.stop, lo + shiftleft(1, s), lo))"
    return f"(size(b{kind}) = 0 or coalesce(get(b{kind}, {nth} - 1).stop <= x.begin, true))"


def _with_candidates(rows: DataFrame) -> DataFrame:
    """Adds base and extra to rows, which have text: arrays of candidates by pattern and place; extra ones touch no base span."""
    rows = rows.withColumns({f"b{p.kind}": F.expr(_candidates(p, i)) for i, p in enumerate(PATTERNS) if p.base} | {"extra": F.concat(*[F.expr(_candidates(p, i)) for i, p in enumerate(PATTERNS) if not p.base])})
    free = f"filter(extra, x -> {' and '.join(map(_clear, range(BASE_KINDS)))})"
    kinds = [f"b{k}" for k in range(BASE_KINDS)]
    return rows.withColumns({"base": F.concat(*kinds), "extra": F.expr(free)}).drop(*kinds)


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, base, extra): arrays of candidates by pattern and place; extra ones touch no base span."""
    return _with_candidates(docs.select(F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("text"))).drop("text")


def estimate(patterns: list[tuple[tuple[int, ...], int]], rounds: int = 30) -> tuple[list[float], list[dict[int, tuple[float, float]]]]:
    """Expectation-maximisation. patterns: (n, votes...) and counts. Probability of each pattern, and of each vote (false, true) by labeler."""
    prior: dict[int, float] = {}
    votes = [{v: (p0, p1) for v, p0, p1 in ((-1, 0.6, 0.1), (0, 0.3, 0.3), (1, 0.1, 0.6))} for _ in range(LABELERS)]
    posterior = [0.5] * len(patterns)
    for _ in range(rounds):
        for i, (x, _) in enumerate(patterns):
            p1 = prior.get(x[0], 0.5)
            p0 = 1 - p1
            for j in range(LABELERS):
                p0, p1 = p0 * votes[j][x[j + 1]][0], p1 * votes[j][x[j + 1]][1]
            posterior[i] = p1 / (p0 + p1)
        for n in {x[0] for x, _ in patterns}:
            own = [(c, q) for (x, c), q in zip(patterns, posterior, strict=True) if x[0] == n]
            prior[n] = (sum(c * q for c, q in own) + 1) / (sum(c for c, _ in own) + 2)
        for j in range(LABELERS):
            mass = {v: [1e-3, 1e-3] for v in (-1, 0, 1)}
            for (x, c), q in zip(patterns, posterior, strict=True):
                mass[x[j + 1]][0] += c * (1 - q)
                mass[x[j + 1]][1] += c * q
            whole = [sum(m[y] for m in mass.values()) for y in (0, 1)]
            votes[j] = {v: (m[0] / whole[0], m[1] / whole[1]) for v, m in mass.items()}
    return posterior, votes


def classifier(patterns: list[tuple[tuple[int, ...], int]], rounds: int = 200) -> dict[tuple[str, int], float]:
    """Logistic regression on the estimated probabilities. patterns: values of SEEN and counts. Weight of each (column, value)."""
    posterior, _ = estimate([(x[: LABELERS + 1], c) for x, c in patterns])
    weights: dict[tuple[str, int], float] = {}
    total = sum(c for _, c in patterns)
    for _ in range(rounds):
        slope: dict[tuple[str, int], float] = {}
        for (x, c), q in zip(patterns, posterior, strict=True):
            keys = list(zip(SEEN, x, strict=True))
            z = sum(weights.get(k, 0.0) for k in keys)
            d = c * (1 / (1 + math.exp(-max(-50.0, min(50.0, z)))) - q) / total
            for k in keys:
                slope[k] = slope.get(k, 0.0) + d
        for k, d in slope.items():
            weights[k] = weights.get(k, 0.0) - 2.0 * (d + 1e-4 * weights.get(k, 0.0))
    return weights


def train(found: DataFrame) -> dict[tuple[str, int], float]:
    """found: candidates(). What reaches the driver is one row for each pattern of SEEN."""
    counts = found.select(F.explode(F.concat("base", "extra")).alias("x")).groupBy(*[F.col(f"x.{c}").alias(c) for c in SEEN]).count().orderBy(*SEEN).collect()
    return classifier([(tuple(r[c] for c in SEEN), r["count"]) for r in counts])


def accepted(weights: dict[tuple[str, int], float], row: str = "x.") -> str:
    """SQL: whether a candidate's probability reaches ACCEPTED."""
    terms = [f"case {row}{c} " + " ".join(f"when {v} then {w!r}D" for (k, v), w in sorted(weights.items()) if k == c) + " else 0D end" for c in SEEN if any(k == c for k, _ in weights)]
    return f"({' + '.join(terms) or '-1D'}) >= {math.log(ACCEPTED / (1 - ACCEPTED))!r}D"


def _written(array: str) -> Column:
    """kind:start:end, comma-joined."""
    kinds = ", ".join(f"'{k}'" for k in KINDS)
    return F.expr(f"array_join(transform({array}, s -> concat(array({kinds})[s.k], ':', s.begin, ':', s.stop)), ',')")


def _spans(weights: dict[tuple[str, int], float]) -> str:
    """SQL: array of base spans and accepted extra ones."""
    return f"transform(concat(base, filter(extra, x -> {accepted(weights)})), x -> named_struct('k', x.k, 'begin', x.begin, 'stop', x.stop))"


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_email, n_ip, n_card, n_phone, base, spans, all_spans) for each row of docs.

    base and spans write the base spans and all spans as kind:start:end by kind, then start; code
    points, end exclusive. all_spans holds the latter as structs. Null and empty texts have none;
    a very long text is searched whole, in time in proportion to its length. Repeated rows get
    equal values; ids may be null. An empty table gives an empty one. Other columns aren't read.
    """
    found = common.checkpoint(candidates(docs, id_col, text_col))
    both = f"array_sort({_spans(train(found))})"
    counts = [F.expr(f"cast(size(filter(base, x -> x.k = {i})) as bigint)").alias(f"n_{k}") for i, k in enumerate(KINDS[:BASE_KINDS])]
    return found.select("id", *counts, _written("base").alias("base"), F.expr(both).alias("all_spans")).withColumn("spans", _written("all_spans"))


def _largest(array: str) -> str:
    """Running maxima of an array of longs, each of what stands before; in chunks, as _running."""
    step = lambda xs, tag, start: f"aggregate({xs}, array({start}), (a{tag}, v{tag}) -> array_append(a{tag}, greatest(element_at(a{tag}, -1), v{tag})))"
    chunks = f"transform(sequence(0, greatest(0, size(xs) - 1) div {CHUNK}), c -> {step(f'slice(xs, c * {CHUNK} + 1, {CHUNK})', '1', '0L')})"
    ends = step("transform(cs, t -> element_at(t, -1))", "2", "0L")
    whole = "flatten(transform(cs, (g, i) -> transform(slice(g, 1, size(g) - 1), y -> greatest(y, es[i]))))"
    return _let(array, "xs", _let(chunks, "cs", _let(ends, "es", f"array_append({whole}, element_at(es, -1))")))


def _cut(begin: str, stop: str) -> str:
    """SQL: code points of the pieces cs from begin to stop."""
    first, last = f"int(a div {PIECE})", f"int((b - 1) div {PIECE})"
    one = f"substr(cs[{first}], int(a % {PIECE}) + 1, int(b - a))"
    more = f"concat(substr(cs[{first}], int(a % {PIECE}) + 1), array_join(slice(cs, {first} + 2, {last} - {first} - 1), ''), substr(cs[{last}], 1, int((b - 1) % {PIECE}) + 1))"
    return _let(begin, "a", _let(stop, "b", f"case when b <= a then '' when {first} = {last} then {one} else {more} end"))


def masked() -> str:
    """SQL: text with its spans (structs begin, k, stop, in order) replaced by the kind in brackets; spans that touch share the first one's mark."""
    kinds = ", ".join(f"'[{k.upper()}]'" for k in KINDS)
    parts = f"transform(spans, (x, i) -> if(x.begin < rs[i], '', concat({_cut('rs[i]', 'x.begin')}, array({kinds})[x.k])))"
    whole = f"concat(array_join({parts}, ''), {_cut('element_at(rs, -1)', 'cast(length(text) as bigint)')})"
    pieces = f"regexp_extract_all(text, r'(?s).{{1,{PIECE}}}', 0)"
    return f"if(size(spans) = 0, text, {_let(pieces, 'cs', _let(_largest('transform(spans, x -> x.stop)'), 'rs', whole))})"


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the spans that find gives replaced by [EMAIL], [IP], [CARD], [PHONE] or [SECRET]; all columns stay, in order.

    Spans that overlap give one mark, that of the first. Null texts stay null, empty ones empty;
    very long texts are masked whole. Ids aren't read; repeated rows stay repeated; an empty table
    gives an empty one. Columns may have any names.
    """
    names = docs.columns
    kept = [F.col(f"`{c}`").alias(f"c_{i}") for i, c in enumerate(names) if c != text_col]
    rows = common.checkpoint(_with_candidates(docs.select(*kept, F.col(f"`{text_col}`").alias("text"))))
    spans = f"array_sort(transform({_spans(train(rows))}, x -> named_struct('begin', x.begin, 'k', x.k, 'stop', x.stop)))"
    rows = rows.withColumn("spans", F.expr(spans)).withColumn("text", F.expr(masked()))
    return rows.select(*[F.col("text" if c == text_col else f"c_{i}").alias(c) for i, c in enumerate(names)])
