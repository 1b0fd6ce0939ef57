import hashlib
import random
import re
import time

from stepframe.llm import op2_pii

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        d = int(d) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            good = {
                "email": True,
                "ip": kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")),
                "card": 16 <= len(digits) <= 19 and luhn(digits),
                "phone": 8 <= len(digits) <= 15,
            }[kind]
            if good:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def texts():
    random.seed(7)
    parts = ["a@b.c", "x_d@e.f", "@", ".", "1.2.3.4", "300.1.2.3", "+1 (555) 123-4567", "4111 1111 1111 1111", "4111111111111111", "-", " ", "é", "9", "0007.1.1.001", "+12345678901234567", "😀", "foo", "mail: bob [at] x [dot] org", "(555) 123-4567", "\n", "4111-1111-1111-1112", "5500 0000 0000 0004 1"]
    fixed = [None, "", "9" * 30_000, "a" * 50_000, "a@b.cx_d@e.f@g.h", "1.2.3.4.5.6.7.8", "+" * 200 + "1" * 50, "é 4111 1111 1111 1111 é a@b.co", "9 " * 4_000]
    return fixed + ["".join(random.choice(parts) for _ in range(random.randint(1, 12))) for _ in range(400)]


def test_base_spans_match_brute_force(spark):
    rows = [(i, t, "x") for i, t in enumerate(texts())]
    docs = spark.createDataFrame([*rows, rows[5]], "doc_id long, text string, base string")
    got = op2_pii.find_pii(docs).collect()
    assert len(got) == len(rows) + 1
    for r in got:
        want = base_spans(rows[r.doc_id][1])
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest(), rows[r.doc_id][1]
        spans = r.spans.split(",") if r.spans else []
        assert set(want) <= set(spans)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(w.startswith(k + ":") for w in want) for k in PATTERNS]
        order = [(list(PATTERNS).index(k), int(a)) for k, a, _ in (s.split(":") for s in spans)]
        assert order == sorted(order)


def test_redaction_keeps_columns_and_clean_rows(spark):
    docs = spark.createDataFrame([(1, "write to a@b.co or +1 (555) 123-4567 now", "k", 3), (2, "clean", "k", 4), (3, None, "k", 5)], "doc_id long, text string, spans string, base int")
    out = {r.doc_id: r for r in op2_pii.redact(docs).collect()}
    assert out[1].text == "write to [EMAIL] or [PHONE] now" and out[2].text == "clean" and out[3].text is None
    assert out[1].spans == "k" and out[3].base == 5


def with_check_digit(body):
    return next(body + str(d) for d in range(10) if luhn([int(c) for c in body + str(d)]))


def planted(seed, n, loose):
    """Texts with one item each, and its place if it is personal data; ``loose`` ones meet no base pattern."""
    rng, out = random.Random(seed), []
    word = lambda: "".join(rng.choice("abdeilmnorst") for _ in range(rng.randint(2, 7)))
    digits = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    for _ in range(n):
        kind, good = rng.choice(list(PATTERNS)), not loose or rng.random() < 0.6
        before, after = " ".join(word() for _ in range(6)) + " ", " " + " ".join(word() for _ in range(4))
        if kind == "email":
            item = f"{word()}@{word()}.com" if not loose else f"{word()} [at] {word()} [dot] {'org' if good else '7'}"
        elif kind == "ip":
            parts = [str(rng.randint(1, 255)) for _ in range(4)]
            item = ("-" if loose else ".").join(parts if good else [str(rng.randint(256, 999)), *parts[1:]])
        elif kind == "card":
            item = with_check_digit("4" + digits(14))
            item = item if good else item[:-1] + str((int(item[-1]) + rng.randint(1, 9)) % 10)
            item = ".".join(item[i : i + 4] for i in range(0, 16, 4)) if loose else item
        else:
            item = f"({rng.randint(200, 999)}) 555-{digits(4)}"
            item = item if loose else f"+1 {item}"
            if not good:
                before, after = before + digits(3) + " ", " " + digits(2) + after
        out.append((before + item + after, f"{kind}:{len(before)}:{len(before) + len(item)}" if good else ""))
    return out


def test_added_spans_are_right_on_held_out_texts(spark):
    shown, unseen = planted(1, 600, False), planted(2, 400, True)
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(shown)], "doc_id long, text string")
    models = op2_pii.train(docs)
    more = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(unseen)], "doc_id long, text string")
    assert all(not base_spans(t) for t, _ in unseen)
    got = {r.doc_id: {f"{op2_pii.KINDS[x.k]}:{x.start}:{x.end}" for x in r.spans} for r in op2_pii.detect(more, models).collect()}
    want = {i: {w} - {""} for i, (_, w) in enumerate(unseen)}
    for kind in PATTERNS:
        of = lambda spans: {(i, x) for i, xs in spans.items() for x in xs if x.startswith(kind)}  # noqa: B023, E731
        right = of(got) & of(want)
        assert len(of(want)) > 30 and len(right) >= 0.9 * len(of(want)) and len(right) >= 0.9 * len(of(got)), kind
    nothing = {k: ([], float("inf")) for k in models}
    assert not any(r.spans for r in op2_pii.detect(more, nothing).collect())


def test_many_matches_in_one_text(spark):
    text = " ".join(f"u{i}@h{i}.org" for i in range(20_000))
    docs = spark.createDataFrame([(1, text), (2, "a@b.co")], "doc_id long, text string")
    start = time.perf_counter()
    got = {r.doc_id: r for r in op2_pii.find_pii(docs).collect()}
    assert got[1].n_email == 20_000 and got[1].base_sha256 == hashlib.sha256(",".join(base_spans(text)).encode()).hexdigest()
    assert time.perf_counter() - start < 120


def test_empty_table(spark):
    assert op2_pii.find_pii(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_boosting_separates_and_threshold_is_calibrated():
    n = len(op2_pii.FEATURES)
    on, off = (True,) * n, (False,) * n
    trees = op2_pii.boosted([(on, True, 50), (off, False, 50)])
    assert op2_pii.score(trees, on) > 0 > op2_pii.score(trees, off)
    assert op2_pii.threshold([(1.0, True, 99), (1.0, False, 1), (0.0, False, 50)]) == 1.0
