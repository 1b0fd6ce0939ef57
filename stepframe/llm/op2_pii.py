"""Personal data by candidate gradient boosting, in DataFrame functions only.

Generators propose spans that may overlap: the four base patterns (all of whose checked matches are kept), their matches
that fail the check, and looser patterns (written-out addresses, numbers without a plus, dashed or dotted groups).
Boosted depth-2 trees over format and context features score what is not a base span. The checked base spans of at most
``SAMPLE_DOCS`` documents (the smallest hashes of key and text) teach them: each is written in its kind's loose form where it
stands and counts as true (an address spelled out, a number without its plus, other signs between the groups), and once more
spoilt (a wrong check digit, a part beyond 255, an end that is no domain, a number amid a row of numbers) and counts as false. Examples are
grouped by feature vector before they reach the driver. Scores are calibrated on held-out documents; a kind's threshold is the
smallest at which held-out precision reaches ``PRECISION``, and a kind without such a threshold, or without base spans to learn from, adds nothing.

No shuffle but for the sample. Null texts are empty and have no spans; repeated rows are treated alike; an empty table gives no
rows and trains nothing. Patterns are possessive where that changes no match, so no text makes them slow or deep.
"""

from __future__ import annotations

import functools
import math
import operator
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
SAMPLE_DOCS = 8_000
PRECISION = 0.95
ROUNDS = 16
SHRINK = 0.3

#: Equivalents of the base patterns: leftmost matches are the same, but each place is tried once.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){15,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
LOOSE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+ ?[\[(]at[\])] ?[A-Za-z0-9-]{1,64}+(?: ?(?:\.|[\[(]dot[\])]) ?[A-Za-z0-9-]{1,64}+)++",
    "ip": r"(?<![0-9.-])[0-9]{1,3}+(?:-[0-9]{1,3}+){3}+(?![0-9.-])",
    "card": r"(?<![0-9])[0-9]{4}(?:[._/ -]?[0-9]{4}){3}+(?![0-9])",
    "phone": r"(?<![0-9A-Za-z+.-])(?:\([0-9]{2,4}\)|[0-9]{2,4}+)[ .-][0-9]{3,4}+[ .-][0-9]{3,4}+(?![0-9A-Za-z-])",
}
#: What a text must hold for a pattern to be worth a search.
_NEEDS = {"email": "@", "phone": "+"}

FEATURES = {
    "plus": "instr(x.s, '+') > 0", "paren": "instr(x.s, '(') > 0", "dash": "instr(x.s, '-') > 0", "dot": "instr(x.s, '.') > 0",
    "space": "instr(x.s, ' ') > 0", "at": "instr(x.s, '@') > 0", "letters": "x.s rlike '[A-Za-z]'",
    "digits_8": "x.digits >= 8", "digits_11": "x.digits >= 11", "digits_16": "x.digits >= 16", "long": "length(x.s) > 30",
    "issuer": "x.s rlike '^[3-6]'", "luhn": "coalesce(luhn_check(regexp_replace(x.s, '[^0-9]', '')), false)", "ends_word": "x.s rlike '[A-Za-z]{2,}$'", "octets": "NOT x.s rlike '[0-9]{4}' AND NOT x.s rlike '(?<![0-9])(?:2(?:5[6-9]|[6-9])|[3-9][0-9])[0-9]'",
    "left_free": "x.left rlike '(?:^|[ \\\\s(:;,\"])$'", "right_free": "x.right rlike '^(?:$|[\\\\s).,;:\"])'",
    "near_mail": "lower(x.left) rlike 'mail|contact'", "near_phone": "lower(x.left) rlike 'phone|tel|call|mobil|fax'",
    "near_host": "lower(x.left) rlike 'ip|host|server|addr'", "near_card": "lower(x.left) rlike 'card|visa|credit|pay|account'",
    "near_number": "x.left rlike '[0-9][ .,/-]?$' OR x.right rlike '^[ .,/-]?[0-9]'",
}


#: Matches whose places are summed up together: arrays grow to this length and to the number of such stretches, not with a text's matches.
STRETCH = 128
_NONE = "CAST(array() AS array<struct<start:int,end:int,s:string>>)"


def _placed(found: str, parts: str) -> Column:
    """Spans (start, end, s) in code points, from the matches and what a split at them leaves."""
    near = f"""transform(sequence(0, (size({found}) - 1) DIV {STRETCH}), b -> aggregate(
        zip_with(slice({parts}, b * {STRETCH} + 1, least({STRETCH}, size({found}) - b * {STRETCH})), slice({found}, b * {STRETCH} + 1, {STRETCH}), (p, m) -> struct(length(p) AS gap, m AS s)),
        struct(0 AS at, {_NONE} AS out),
        (a, x) -> struct(a.at + x.gap + length(x.s) AS at, concat(a.out, array(struct(a.at + x.gap AS start, a.at + x.gap + length(x.s) AS end, x.s AS s))) AS out)))"""
    return F.expr(f"""flatten(transform(array({near}), n -> flatten(zip_with(n,
        aggregate(n, struct(0 AS at, CAST(array() AS array<int>) AS out), (a, l) -> struct(a.at + l.at AS at, concat(a.out, array(a.at)) AS out), a -> a.out),
        (l, o) -> transform(l.out, x -> struct(x.start + o AS start, x.end + o AS end, x.s AS s))))))""")


_CHECK = {
    "email": "true",
    "ip": "forall(split(x.s, '[.]'), p -> length(ltrim('0', p)) <= 3 AND coalesce(try_cast(p AS int), CASE WHEN ltrim('0', p) = '' THEN 0 END, 999) <= 255)",
    "card": "luhn_check(translate(x.s, ' -', ''))",
    "phone": "length(regexp_replace(x.s, '[^0-9]', '')) BETWEEN 8 AND 15",
}


def _spans(docs: DataFrame, text: str) -> DataFrame:
    """Adds base_<kind> (checked matches) and more_<kind> (other candidates), arrays of (start, end, s)."""
    kept = docs.columns
    none = F.expr("CAST(array() AS array<string>)")
    sets = {f"_{g}_{k}": (k, r) for g, rs in (("b", BASE), ("l", LOOSE)) for k, r in rs.items()}
    value = F.coalesce(F.col(text), F.lit(""))
    df = docs.withColumns({
        f"{c}_f": F.when(F.contains(value, F.lit(_NEEDS[k])), F.regexp_extract_all(value, F.lit(r), F.lit(0))).otherwise(none)
        if k in _NEEDS and c[1] == "b" else F.regexp_extract_all(value, F.lit(r), F.lit(0))
        for c, (k, r) in sets.items()
    })
    df = df.withColumns({f"{c}_p": F.when(F.size(f"{c}_f") > 0, F.split(value, r, -1)).otherwise(none) for c, (_, r) in sets.items()})
    df = df.withColumns({c: F.when(F.size(f"{c}_f") > 0, _placed(f"{c}_f", f"{c}_p")).otherwise(F.expr(_NONE)) for c in sets})
    df = df.select(*kept, *sets)
    df = df.withColumns({f"base_{k}": F.expr(f"filter(_b_{k}, x -> {_CHECK[k]})") for k in KINDS})
    more = {f"more_{k}": F.expr(f"concat(filter(_b_{k}, x -> NOT ({_CHECK[k]})), _l_{k})") for k in KINDS}
    return df.withColumns(more).select(*kept, *[f"base_{k}" for k in KINDS], *more)


def _near(array: str, text: str, s: str = "y.s", left: str = "{}", right: str = "{}") -> str:
    """Spans y with what stands around them; ``s``, ``left`` and ``right`` can rewrite what is seen."""
    before, after = f"substring({text}, greatest(y.start - 19, 1), least(y.start, 20))", f"substring({text}, y.end + 1, 4)"
    seen = f"transform({array}, y -> struct(y.start AS start, y.end AS end, {s} AS s, {left.format(before)} AS left, {right.format(after)} AS right))"
    return f"transform({seen}, y -> struct(y.start AS start, y.end AS end, y.s AS s, length(regexp_replace(y.s, '[^0-9]', '')) AS digits, y.left AS left, y.right AS right))"


def _featured(near: str) -> str:
    return f"transform({near}, x -> struct(x.start AS start, x.end AS end, array({', '.join(FEATURES.values())}) AS f))"


_DIGITS = "regexp_replace(y.s, '[^0-9]', '')"
_GROUPED = "regexp_replace({}, '([0-9]{{4}})(?=[0-9])', '$1.')"
#: A base span in loose form.
TRUE = {
    "email": "replace(replace(y.s, '@', IF(y.start % 2 = 0, ' [at] ', '(at)')), '.', IF(y.start % 3 = 0, '.', ' [dot] '))",
    "ip": "replace(y.s, '.', '-')",
    "card": _GROUPED.format(_DIGITS),
    "phone": "regexp_replace(y.s, '^[+][0-9]{1,2}[ -]?', '')",
}
#: One that is spoilt: the rewritten text, and what stands before and after it.
FALSE = {
    "email": ("regexp_replace(replace(y.s, '@', ' [at] '), '[A-Za-z]+$', '7')", "{}", "{}"),
    "ip": ("regexp_replace(replace(y.s, '.', '-'), '^[0-9]+', CAST(300 + y.start % 600 AS string))", "{}", "{}"),
    "card": (_GROUPED.format(f"concat(substring({_DIGITS}, 1, length({_DIGITS}) - 1), CAST((CAST(right({_DIGITS}, 1) AS int) + 1 + y.start % 9) % 10 AS string))"), "{}", "{}"),
    "phone": ("regexp_replace(y.s, '^[+][0-9]{1,2}[ -]?', '')", "concat(substring({}, 1, 14), '731 ')", "concat(' 48', substring({}, 1, 1))"),
}


def sampled_candidates(docs: DataFrame, key: str, text: str) -> list:
    """(kind, held out, feature vector, label, count) over the examples of at most SAMPLE_DOCS documents."""
    rank = F.xxhash64(F.col(key).cast("string"), F.col(text))  # rows that share a rank are alike
    cut = docs.select(rank.alias("h")).orderBy("h").limit(SAMPLE_DOCS).agg(F.max("h")).first()[0]
    if cut is None:
        return []
    few = docs.where(rank <= F.lit(cut)).select(F.coalesce(F.col(text), F.lit("")).alias("t"), (F.pmod(rank, F.lit(3)) == 0).alias("held")).limit(SAMPLE_DOCS)
    few = _spans(few, "t")
    each = [
        f"transform({_featured(_near(f'base_{k}', 't', *how))}, c -> struct('{k}' AS kind, c.f AS f, {label} AS label))"
        for k in KINDS for label, how in (("true", (TRUE[k],)), ("false", FALSE[k]))
    ]
    rows = few.select("held", F.explode(F.expr(f"concat({', '.join(each)})")).alias("c")).select("held", "c.*")
    return rows.groupBy("kind", "held", "f", "label").agg(F.count("*").alias("n")).collect()  # bounded by the sample


def boosted(rows: list[tuple[tuple[bool, ...], bool, int]]) -> list[tuple[int, int, tuple[float, float, float, float]]]:
    """Depth-2 trees (feature a, feature b, leaf values by a and b) by Newton steps on the logistic loss."""
    trees: list[tuple[int, int, tuple[float, float, float, float]]] = []
    margin = [0.0] * len(rows)
    pairs = list(combinations(range(len(FEATURES)), 2))
    for _ in range(ROUNDS if rows else 0):
        p = [1 / (1 + math.exp(-m)) for m in margin]
        grad = [n * (y - q) for (_, y, n), q in zip(rows, p, strict=True)]
        hess = [n * q * (1 - q) for (_, _, n), q in zip(rows, p, strict=True)]
        best, gain = None, 1e-6
        for a, b in pairs:
            g, h = [0.0] * 4, [1.0] * 4
            for (f, _, _), gi, hi in zip(rows, grad, hess, strict=True):
                leaf = 2 * f[a] + f[b]
                g[leaf] += gi
                h[leaf] += hi
            if (total := sum(x * x / y for x, y in zip(g, h, strict=True))) > gain:
                best, gain = (a, b, tuple(SHRINK * x / y for x, y in zip(g, h, strict=True))), total
        if best is None:
            break
        trees.append(best)
        margin = [m + best[2][2 * f[best[0]] + f[best[1]]] for m, (f, _, _) in zip(margin, rows, strict=True)]
    return trees


def score(trees: list, f: tuple[bool, ...]) -> float:
    """Added up in the order that SQL does: ``sum`` rounds otherwise."""
    return functools.reduce(operator.add, (leaves[2 * f[a] + f[b]] for a, b, leaves in trees), 0.0)


def threshold(scored: list[tuple[float, bool, int]]) -> float:
    """The least score from which held-out precision is PRECISION; infinite if there is none."""
    best, right, all_ = math.inf, 0, 0
    by: dict[float, list[int]] = {}
    for s, y, n in scored:
        c = by.setdefault(s, [0, 0])
        c[0] += n * y
        c[1] += n
    for s in sorted(by, reverse=True):
        right, all_ = right + by[s][0], all_ + by[s][1]
        if right >= PRECISION * all_:
            best = s
    return best


def train(docs: DataFrame, key: str = "doc_id", text: str = "text") -> dict[str, tuple[list, float]]:
    """By kind, trees and threshold."""
    rows = sorted((r.kind, r.held, tuple(r.f), r.label, r.n) for r in sampled_candidates(docs, key, text))
    models = {}
    for kind in KINDS:
        trees = boosted([(f, y, n) for k, held, f, y, n in rows if k == kind and not held])
        held = [(score(trees, f), y, n) for k, h, f, y, n in rows if k == kind and h]
        models[kind] = (trees, threshold(held) if trees else math.inf)
    return models


def _chosen(kind: str, model: tuple[list, float], text: str) -> str:
    """SQL of the added spans of a kind: scored over the threshold, and clear of every base span."""
    trees, least = model
    if not trees or math.isinf(least):
        return "CAST(array() AS array<struct<start:int,end:int>>)"
    total = " + ".join(
        f"CASE WHEN c.f[{a}] THEN CASE WHEN c.f[{b}] THEN {v[3]!r}D ELSE {v[2]!r}D END ELSE CASE WHEN c.f[{b}] THEN {v[1]!r}D ELSE {v[0]!r}D END END" for a, b, v in trees
    )
    clear = " AND ".join(f"NOT exists(base_{k}, b -> b.start < c.end AND c.start < b.end)" for k in KINDS)
    return f"transform(filter({_featured(_near(f'more_{kind}', text))}, c -> {clear} AND {total} >= {least!r}D), c -> struct(c.start AS start, c.end AS end))"


def detect(docs: DataFrame, models: dict[str, tuple[list, float]], text: str = "text") -> DataFrame:
    """Adds base and spans: arrays of (k, start, end), k being the place in KINDS, sorted by k and start."""
    own = "__pii_text"
    df = _spans(docs.withColumn(own, F.coalesce(F.col(text), F.lit(""))), own)
    tag = lambda k, array: f"transform({array}, x -> struct({KINDS.index(k)} AS k, x.start AS start, x.end AS end))"
    df = df.withColumn("base", F.expr(f"concat({', '.join(tag(k, f'base_{k}') for k in KINDS)})"))
    added = [tag(k, _chosen(k, models[k], own)) for k in KINDS]
    df = df.withColumn("__all", F.expr(f"array_sort(concat(base, {', '.join(added)}))"))
    df = df.withColumn("spans", F.expr("filter(__all, (x, i) -> i = 0 OR x <> __all[i - 1])"))  # each once, in linear time
    return df.drop(own, "__all", *[f"{g}_{k}" for g in ("base", "more") for k in KINDS])


def _joined(spans: str) -> Column:
    names = ", ".join(f"'{k}'" for k in KINDS)
    return F.expr(f"concat_ws(',', transform({spans}, x -> concat_ws(':', element_at(array({names}), x.k + 1), x.start, x.end)))")


def find_pii(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Counts, digest of the base spans and all spans of each row."""
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    found = detect(rows, train(rows), "text")
    counts = [F.expr(f"CAST(size(filter(base, x -> x.k = {i})) AS long) AS n_{k}") for i, k in enumerate(KINDS)]
    return found.select("doc_id", *counts, F.sha2(_joined("base"), 256).alias("base_sha256"), _joined("spans").alias("spans"))


def redact(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with every span in ``text`` replaced by its kind in brackets; overlapping spans become the first's."""
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), F.struct("*").alias("row"))  # no name can clash
    found = detect(rows, train(rows, "key", "text"), "text")
    names = ", ".join(f"'[{k.upper()}]'" for k in KINDS)
    masked = F.expr(f"""aggregate(
        array_sort(transform(spans, x -> struct(x.start AS start, x.end AS end, x.k AS k))),
        struct(0 AS at, CAST('' AS string) AS out),
        (a, x) -> CASE WHEN x.start >= a.at THEN struct(x.end AS at, concat(a.out, substring(text, a.at + 1, x.start - a.at), element_at(array({names}), x.k + 1)) AS out)
                       ELSE struct(greatest(a.at, x.end) AS at, a.out AS out) END,
        a -> concat(a.out, substring(text, a.at + 1)))""")
    found = found.withColumn("masked", F.when(F.size("spans") > 0, masked).otherwise(F.col("text")))
    return found.select(*[F.col("masked").alias(c) if c == text else F.col("row")[c].alias(c) for c in docs.columns])
