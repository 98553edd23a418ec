"""What the boosted trees add to the base spans: planted spans that no base pattern finds, and near misses."""

import random

import pytest

from stratapoint.llm import pii

DOCS = "doc_id long, text string"


def card(rng):
    body = "4" + "".join(rng.choice("0123456789") for _ in range(14))
    return next(body + d for d in "0123456789" if pii.luhn(body + d))


def phone(rng):
    return f"{rng.randrange(1, 10)} ({rng.randrange(100, 999)}) {rng.randrange(100, 999)}-{rng.randrange(1000, 9999)}"


def secret(rng):
    return "".join(rng.choice("0123456789abcdef") for _ in range(rng.choice((32, 40))))


@pytest.fixture(scope="module")
def planted(spark):
    """Rows to learn from, rows with spans that only the model can find, and rows with near misses."""
    rng = random.Random(7)
    words = lambda n: " ".join("".join(rng.choice("abcdefghilmnorst") for _ in range(rng.randrange(2, 9))) for _ in range(n))
    rows, hidden, misses = [], {}, set()
    for i in range(500):
        kinds = {"email": f"{words(1)}.{i}@{words(1)}.org", "ip": ".".join(str(rng.randrange(1, 255)) for _ in range(4)), "card": card(rng), "phone": "+" + phone(rng), "secret": f'api_key = "{secret(rng)}"'}
        rows.append((i, f"{words(20)} {kinds[rng.choice(list(kinds))]} {words(20)} {kinds[rng.choice(list(kinds))]} {words(5)}"))
    for i in range(1000, 1100):
        number = card(rng)
        kind, said = rng.choice([("email", f"{words(1)}{i} (at) {words(1)}.org"), ("card", ".".join(number[k : k + 4] for k in range(0, 16, 4))), ("phone", phone(rng)), ("secret", secret(rng))])
        before = f"{words(9)} password: '" if kind == "secret" else f"{words(9)} "
        rows.append((i, f"{before}{said}{chr(39) if kind == 'secret' else ''} {words(9)}"))
        hidden[i] = (kind, len(before), len(before) + len(said))
    for i in range(2000, 2100):
        number = card(rng)
        spoilt = number[:-1] + str((int(number[-1]) + 3) % 10)
        year = rng.randrange(1900, 2020)
        rows.append((i, f"{words(9)} {rng.choice([spoilt, f'{year}-{year + 4} {year + 9}', '300.400.500.600', f'{words(1)}-{words(1)}-{words(1)}-{i}', f'{i}.000.000'])} {words(9)}"))
        misses.add(i)
    return spark.createDataFrame(rows, DOCS).repartition(8), hidden, misses


def test_the_trees_add_what_the_patterns_miss(spark, planted):
    docs, hidden, misses = planted
    model = pii.learn(docs)
    assert set(model.thresholds) == set(pii.ALL_KINDS) and all(0.5 <= t <= 1 for t in model.thresholds.values())
    added = {r.doc_id: [(s.kind, s.start, s.end) for s in r.spans if not s.base] for r in pii.find(docs, model).collect()}
    right = sum(span in added[i] for i, span in hidden.items())
    given = sum(len(added[i]) for i in (*hidden, *misses))
    print("recall", right / len(hidden), "precision", right / given)
    wrong = {i: added[i] for i in misses if added[i]}
    print(wrong)
    assert right / len(hidden) >= 0.85
    assert right / given >= 0.95
    assert sum(bool(added[i]) for i in misses) <= 2


def test_spans_never_touch_and_texts_are_redacted(spark, planted):
    docs, hidden, _ = planted
    found = pii.find(docs, pii.learn(docs))
    for r in found.collect():
        for s in (s for s in r.spans if not s.base):
            assert not any(o != s and o.start < s.end and s.start < o.end for o in r.spans)
    out = {r.doc_id: r for r in pii.redact(found).where("doc_id >= 1000 and doc_id < 1100").collect()}
    for i, (kind, start, end) in hidden.items():
        r = out[i]
        if any((s.start, s.end) == (start, end) for s in r.spans) and len(r.spans) == 1:
            assert r.redacted == f"{r.text[:start]}[{kind}]{r.text[end:]}"
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "nothing here"), (3, "nothing here"), (None, "+1 (555) 123-4567")], DOCS)
    rows = pii.redact(pii.find(odd, pii.learn(odd))).collect()
    assert sorted(str(r.redacted) for r in rows) == ["", "None", "[phone]", "nothing here", "nothing here"]


def test_many_places_take_linear_time():
    text = " ".join(f"{i % 200}.{i % 7}.{i % 9}.{i % 11} {4000000000000000 + i}" for i in range(40_000))
    base = pii.base_spans(text)
    taken = pii.Taken([s for spans in base.values() for s in spans])
    assert sum(taken.touch(a, b) for _, a, b in pii.candidates(text)) >= len(base["ip"])
    assert len(pii.SpanModel({}, {}, {}).added([text], [base])[0]) == 0
