import random

import numpy as np

from tektonis.llm import leaks

RNG = random.Random(5)
WORDS = ["".join(RNG.choice("abcdefghiklmnoprstu") for _ in range(RNG.randrange(2, 9))) for _ in range(400)]


def text(n, rng=RNG):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def brute(items, docs):
    """Every pair, by alignment alone."""
    out = set()
    for d, t in docs:
        if t:
            s, _ = leaks.normal_form(t)
            out |= {(d, i) for i, x in items if s and leaks.leaked(*leaks.normal_form(x), s)}
    return out


def test_normal_form():
    a, starts = leaks.normal_form("Die Dä­mmung, ﬁn 5,2!")
    assert a == "diedaemmungfin52" and starts == [0, 3, 11, 14, 15]
    assert leaks.normal_form("墙还干燥吗？")[1] == [0, 1, 2, 3, 4]


def test_equal_windows_share_all_keys_and_near_ones_some():
    walks = leaks.Walks()
    s = leaks.normal_form(text(60))[0]
    near = s[:40] + "x" + s[41:]
    keys = lambda x: {(t, int(k[0])) for t, _, k in walks.keys(leaks.codes(x), np.array([0]), np.array([len(x)]))}
    assert keys(s) == keys(s[:200]) and len(keys(s) & keys(near)) > len(keys(s)) * 0.2


def test_find(spark):
    items = [(i, text(40)) for i in range(12)] + [(50, "brief note here"), (53, "a note of some thirty letters at most"), (51, None), (52, "")]
    docs, rng = [], random.Random(9)
    for n in range(60):
        i, x = items[n % 12]
        w = x.split()
        kind = n % 5
        if kind == 0:
            part = w
        elif kind == 1:
            part = w[5:30]  # more than half
        elif kind == 2:
            part = w[:12]  # less than half
        elif kind == 3:
            part = [y[:-1] + "q" if rng.random() < 0.06 else y for y in w]  # a few altered words
        else:
            part = [rng.choice(WORDS) if k % 3 == 0 else y for k, y in enumerate(w)]  # every third word another
        docs.append((n, text(20) + ". " + " – ".join(part).upper() + " " + text(25)))
    docs += [(100, None), (101, " "), (102, text(8) + " Brief  note: here " + text(4)), (103, text(60_000) + " " + items[3][1]), (104, text(9) + " some THIRTY letters " + text(9)), (0, docs[0][1])]
    d = spark.createDataFrame(docs, "doc_id bigint, text string").selectExpr("*", "1 AS item_id", "2 AS key", "3 AS item")
    it = spark.createDataFrame(items, "item_id bigint, text string").selectExpr("*", "1 AS doc_id")
    got = {tuple(r) for r in leaks.find_leaks(d, it).collect()}
    assert (103, 3) in got and (102, 50) in got and (104, 53) in got
    want = brute([x for x in items if x[1]], [x for x in docs if x[0] != 103])
    small = {x for x in got if x[0] != 103}
    assert small <= want and len(small) >= 0.95 * len(want)
    assert {n for n, _ in small if n < 60} >= {n for n in range(60) if n % 5 in (0, 1)} and not {n for n, _ in small if n < 60 and n % 5 in (2, 4)}
    assert {tuple(r) for r in leaks.find_leaks(d, it, map_bits=8, send_limit=0).collect()} == got
    assert leaks.find_leaks(d.limit(0), it).count() == 0 and leaks.find_leaks(d, it.limit(0)).count() == 0


def test_altered_words_of_two_characters():
    rng = random.Random(3)
    item = "".join(chr(0x4E00 + rng.randrange(3000)) for _ in range(200))
    words = [item[i : i + 2] for i in range(0, 200, 2)]
    altered = lambda step: "".join("\u9f00\u9f01" if i % step == step // 2 else w for i, w in enumerate(words))
    s, starts = leaks.normal_form(item)
    assert leaks.leaked(s, starts, leaks.normal_form(altered(10))[0])  # one word in ten
    assert not leaks.leaked(s, starts, leaks.normal_form(altered(5))[0])  # one in five
    assert leaks.altered_pairs([]) == 0 and leaks.altered_pairs([4, 5, 6, 9]) == 3 and leaks.altered_pairs([7] * 5) == 3


def stretch(item, doc, share=0.5, edits=2):
    """Whether `doc` has a substring within `edits` of a part of `item` of the given share, by a plain table of best starts (no alignment score, no q-gram)."""
    n, need = len(item), -(-len(item) * share // 1)
    # for every place of the item and of the document: the longest part of the item that ends here with e edits
    prev = [[0] * (len(doc) + 1) for _ in range(edits + 1)]
    for i in range(1, n + 1):
        cur = [[0] * (len(doc) + 1) for _ in range(edits + 1)]
        for e in range(edits + 1):
            row, up, less, less_up = cur[e], prev[e], cur[e - 1], prev[e - 1]
            for j in range(1, len(doc) + 1):
                best = up[j - 1] + 1 if item[i - 1] == doc[j - 1] else 0
                if e:
                    best = max(best, less_up[j - 1] + 1, less_up[j] + 1, less[j - 1])
                row[j] = best
                if best >= need:
                    return True
        prev = cur
    return False


def test_short_items(spark):
    rng = random.Random(11)
    words = ["".join(rng.choice("abcdefghiklmnoprstu") for _ in range(rng.randrange(3, 9))) for _ in range(900)]
    some = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [(i, some(3 + i % 4)) for i in range(120)]
    docs = []
    for i, t in items:
        w = t.split()
        k = rng.randrange(len(w))
        at = rng.randrange(len(w[k]))
        w[k] = w[k][:at] + "q" + w[k][at + 1 :]  # one word altered
        docs.append((i, f"{some(30)} {' '.join(w)} {some(30)}"))
    d, it = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    got = {tuple(r) for r in leaks.find_leaks(d, it).collect()}
    forms = {i: leaks.normal_form(t) for i, t in items}
    planted = {(i, i) for i, t in docs if leaks.leaked(*forms[i], leaks.normal_form(t)[0])}
    assert len(planted) > 90 and len(got & planted) >= 0.9 * len(planted)
    assert all(stretch(forms[i][0], leaks.normal_form(docs[d][1])[0]) for d, i in got)
