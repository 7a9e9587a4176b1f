import random
import re

from cellgrid.llm.leakage import leaked
from cellgrid.llm.lookalike import Folder

F = Folder({})


def words(t):
    return [w for w in re.sub(r"[^\w\s]|_", "", F.form(t).lower()).split() if w]


def near(d, v):
    """Whether a window of v stands in d but for one word replaced, left out or put in."""
    for b in range(len(v) - 11):
        w = v[b : b + 12]
        for s in range(len(d) - 10):
            part = d[s : s + 12]
            if len(part) == 12 and sum(x == y for x, y in zip(part, w)) >= 11:
                return True
            for c in range(1, 11):
                if d[s : s + c] == w[:c] and d[s + c : s + 11] == w[c + 1 :]:
                    return True
                if d[s : s + c] == w[:c] and d[s + c + 1 : s + 13] == w[c:]:
                    return True
    return False


def brute(docs, items):
    """Every alignment of every pair, word by word."""
    return {(i, k) for i, t in docs for k, q, a, p in items for side in (" ".join(x for x in (q, a) if x), p) if near(words(t or ""), words(side or ""))}


def plain(docs, items):
    """Replaced words alone."""
    out = set()
    for i, t in docs:
        d = words(t or "")
        for k, q, a, p in items:
            for side in (" ".join(x for x in (q, a) if x), p):
                v = words(side or "")
                for s in range(-len(v), len(d)):
                    same = [d[j + s] == w if 0 <= j + s < len(d) else None for j, w in enumerate(v)]
                    for b in range(len(v) - 11):
                        part = same[b : b + 12]
                        if None not in part and sum(part) >= 11:
                            out.add((i, k))
    return out


def test_against_brute_force(spark):
    rnd = random.Random(5)
    vocab = ["a", "of", "the", "rïver", "gained", "4.5%", "Wonk-Labs", "x", "métres", "crowns", "(2013)", "by"] + [f"w{i}" for i in range(40)]
    text = lambda n: [rnd.choice(vocab) for _ in range(n)]
    items = [(k, " ".join(text(14)) + "?", " ".join(text(3)), " ".join(text(30))) for k in range(12)]
    items += [(50, "too short", "yes", "a b c"), (51, None, None, None), (52, "", "x", " ".join("abcdefghijklmnop"))]
    docs = []
    for i in range(120):
        t = text(rnd.randrange(0, 60))
        if items and rnd.random() < 0.6:
            k, q, a, p = items[rnd.randrange(12)]
            src = (p if rnd.random() < 0.6 else q + " " + a).split()
            n = rnd.randrange(8, 16)
            s = rnd.randrange(0, max(1, len(src) - n))
            part = src[s : s + n]
            for _ in range(rnd.choice([0, 1, 1, 2])):
                at = rnd.randrange(len(part))
                part[at : at + rnd.choice([1, 1, 0])] = rnd.choice([["REPLACED"], ["z"], ["averyveryveryverylongreplacementwordindeedmorethanthirtytwochars"], []])
            t += [w.upper() + rnd.choice(["", ",", ";"]) for w in part] + text(5)
        docs.append((i, rnd.choice([" ", "\n", "  "]).join(t).replace("e", rnd.choice(["e", "е", "ｅ"]))))
    docs += [(900, None), (901, ""), (902, "ABCDEFGHIJKLMNOP".replace("", " ")), (903, " ".join(["pad"] * 400) + " " + items[0][3])]
    d = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, item_id long")
    i = spark.createDataFrame(items, "item_id long, question string, answer string, passage string")
    want = sorted(brute(docs, items))
    assert len(want) > 20 and set(want) > plain(docs, items)
    for block in (10**6, 300):
        assert sorted(map(tuple, leaked(d, i, block=block).collect())) == want


def test_layout_and_signs(spark):
    v = "the delta of the river gained 23 % against 41 % near Wonk-Labs in the spring of 2011 by count"
    i = spark.createDataFrame([(1, None, None, v)], "item_id long, question string, answer string, passage string")
    docs = {
        1: "x " + v.replace("delta", "del-\nta").replace("near", "ne-\n   ar") + " y", 2: v.replace("river", "stream"), 3: v.replace("spring", "wet spring"), 4: v.replace(" of the river", ""),
        5: " ".join(v.split()[:7] + v.split()[8:13]), 6: " ".join(v.split()[:9]), 7: " ".join(v.split()[4:16]).replace("against", "over"), 8: "> " + v.replace(" gained", "\n> gained").replace("near", "\n> near"),
        9: "lead " * 200000 + v, 10: v.replace("41", "4 1 0").replace("Wonk-Labs", "W onk"),
    }
    d = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    for block in (10**6, 50):
        assert {r.doc_id for r in leaked(d, i, block=block).collect()} == {1, 2, 3, 4, 5, 7, 8, 9}


def test_empty(spark):
    d = spark.createDataFrame([(1, "x")], "doc_id long, text string")
    i = spark.createDataFrame([(1, "q", "a", "p")], "item_id long, question string, answer string, passage string")
    assert leaked(d, i.limit(0)).count() == 0 and leaked(d.limit(0), i).count() == 0
