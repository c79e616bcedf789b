import hashlib

import pytest

from tektonis.llm import mixing


def brute(docs, targets, seed="mix"):
    size = {}
    for d, s, n in docs:
        if s in {t[0] for t in targets} and n:
            size.setdefault(s, []).append((int(hashlib.md5(f"{seed}{d}".encode()).hexdigest()[:12], 16), d, n))
    live = [t for t in targets if t[0] in size and t[1] > 0]
    shares = {s: a / sum(x[1] for x in live) for s, a, _ in live}
    total = min(sum(x[2] for x in size[s]) * r / shares[s] for s, _, r in live)
    out = {}
    for s, _, r in live:
        have = sum(x[2] for x in size[s])
        budget = int(min(total * shares[s] + 1e-6, have * r))
        place = 0
        for _, d, n in sorted(size[s]):
            place += n
            copies = budget // have + (place <= budget % have)
            if copies:
                out[d] = copies
    return out


@pytest.mark.parametrize("rows_per_range", [3, 1000])
def test_mix(spark, rows_per_range):
    docs = [(i, "abc"[i % 7 % 3], 10 + i % 13) for i in range(200)] + [(900, None, 5), (901, "z", 5), (902, "a", None), (903, "a", 0)]
    targets = [("a", 0.5, 1), ("b", 0.3, 2), ("c", 0.1, 4), ("none", 0.1, 2)]
    d = spark.createDataFrame(docs, "doc_id bigint, source string, n_tokens bigint").selectExpr("*", "1 AS size", "2 AS bucket", "3 AS rnd")
    t = spark.createDataFrame(targets, "source string, target_share double, max_repeat int")
    chosen, report = mixing.mix(d.drop("size"), t, rows_per_range=rows_per_range)
    got = {r.doc_id: r.copies for r in chosen.collect()}
    assert got == brute(docs, targets)
    rep = {r.source: r for r in report.collect()}
    assert rep["none"].share == 0 and abs(rep["a"].share - 0.5 / 0.9) < 0.02 and all(got[k] <= {"a": 1, "b": 2, "c": 4}["abc"[k % 7 % 3]] for k in got)
    more, full = mixing.mix(d.drop("size"), t, total=10**9)
    assert {r.copies for r in more.where("source = 'b'").collect()} == {2} and full.count() == 4
    empty, none = mixing.mix(d.drop("size").limit(0), t)
    assert empty.count() == 0 and {r.selected for r in none.collect()} == {0}


def test_tokens(spark):
    path = mixing.TOKENIZER
    pytest.importorskip("tiktoken")
    d = spark.createDataFrame([(1, "Die Wand <|endoftext|> ist nass."), (2, ""), (3, None), (4, "墙 " * 20000)], "doc_id bigint, text string")
    got = {r.doc_id: r.n_tokens for r in mixing.with_token_counts(d, "doc_id", "text", path).collect()}
    enc = mixing.encoding(path)
    assert got == {1: len(enc.encode_ordinary("Die Wand <|endoftext|> ist nass.")), 2: 0, 4: len(enc.encode_ordinary("墙 " * 20000))}
    assert enc.decode(enc.encode_ordinary("Dämmung 5 cm")) == "Dämmung 5 cm"
