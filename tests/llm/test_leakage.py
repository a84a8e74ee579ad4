import random

from orderloom.llm import leakage
from orderloom.llm.leakage import LeakIndex, find_leaks, kept_in_order, nearest, words_of

RNG = random.Random(4)
VOCAB = [f"w{i}" for i in range(60)]
ITEMS = [(i, " ".join(RNG.choice(VOCAB) for _ in range(n))) for i, n in enumerate([40, 60, 25, 15, 8, 30])]


def slow_distance(p, t):
    row = [0] * (len(t) + 1)
    for i, x in enumerate(p, 1):
        now = [i]
        for j, y in enumerate(t, 1):
            now.append(min(row[j] + 1, now[j - 1] + 1, row[j - 1] + (x != y)))
        row = now
    return min(row)


def slow_common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        now = [0]
        for j, y in enumerate(b, 1):
            now.append(max(row[j], now[j - 1], row[j - 1] + (x == y)))
        row = now
    return row[-1]


def bits(p):
    out = {}
    for i, x in enumerate(p):
        out[x] = out.get(x, 0) | 1 << i
    return out


def test_bit_parallel_measures():
    for _ in range(300):
        p = [RNG.randrange(4) for _ in range(RNG.randrange(1, 90))]
        t = [RNG.randrange(5) for _ in range(RNG.randrange(0, 120))]
        assert nearest(bits(p), len(p), t)[0] == min(slow_distance(p, t), len(p))
        assert kept_in_order(bits(p), len(p), t) == slow_common(p, t)


def edited(words, changes, seed):
    rng, out = random.Random(seed), []
    at = set(rng.sample(range(1, len(words) - 1), changes))
    for i, w in enumerate(words):
        if i in at:
            kind = i % 3
            if kind == 0:
                out.append("other")
            elif kind == 2:
                out += [w, "added"]
        else:
            out.append(w)
    return out


def test_leaks():
    ix = LeakIndex(ITEMS)
    word = {i: t.split() for i, t in ITEMS}
    noise = " nothing of it here "
    assert ix.leaks(noise + " ".join(word[0][5:17]) + noise) == {0}
    assert ix.leaks(noise + " ".join(word[0][5:16]) + noise) == set()
    assert ix.leaks(" ".join(word[4])) == {4} and ix.leaks(" ".join(word[4][:7])) == set()
    assert ix.leaks(" ".join(word[3][:12])) == {3} and ix.leaks(" ".join(word[3][:11])) == set()
    for i in (0, 1, 2, 5):
        for seed in range(8):
            assert i in ix.leaks(noise + " ".join(edited(word[i], len(word[i]) // 4, seed)) + noise)
        shuffled = word[i][:]
        random.Random(9).shuffle(shuffled)
        assert i not in ix.leaks(" ".join(shuffled))
    assert ix.leaks(None) == set() and ix.leaks("") == set()


def test_case_marks_and_unseen_characters_dont_count():
    assert words_of("<b>Half-Empty</b><br>Crаte​s, \n12") == ["half", "empty", "crates", "12"]


def test_frame(spark):
    docs = spark.createDataFrame([(1, ITEMS[0][1], "x"), (2, None, "x"), (3, "", "x"), (4, ITEMS[0][1].upper().replace(" ", " , ") * 40, "x"), (None, ITEMS[0][1], "x")], "doc_id long, text string, item_id string")
    items = spark.createDataFrame([*[(i, t, "s") for i, t in ITEMS], (0, ITEMS[0][1], "t"), (98, None, "s"), (99, "...", "s")], "item_id long, text string, doc_id string")
    assert {tuple(r) for r in find_leaks(docs, items).collect()} == {(1, 0), (4, 0)}
    assert find_leaks(docs, items.limit(0)).count() == 0 and find_leaks(docs.limit(0), items).count() == 0


def slow_copy(item, doc):
    """Two thirds of the item's words in order in some window in which they can stand with as many edits as are allowed."""
    n = len(item)
    need = -(-n * 2 // 3)
    errors = 2 * (n - need)
    return any(
        slow_distance(item, doc[:end]) <= errors and slow_common(item, doc[max(0, end - n - errors) : end]) >= need and min_end(item, doc, end) <= errors for end in range(1, len(doc) + 1)
    )


def min_end(item, doc, end):
    """Least distance of the item to a part that ends at ``end``."""
    return min(levenshtein(item, doc[start:end]) for start in range(max(0, end - 2 * len(item)), end + 1))


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            now.append(min(row[j] + 1, now[j - 1] + 1, row[j - 1] + (x != y)))
        row = now
    return row[-1]


def test_copies_at_the_limit_against_brute_force():
    rng = random.Random(12)
    items = [(i, " ".join(rng.choice(VOCAB) for _ in range(21 + 3 * i))) for i in range(4)]
    ix = LeakIndex(items)
    hits = 0
    for trial in range(40):
        i = trial % 4
        w = items[i][1].split()
        lost = set(rng.sample(range(len(w)), len(w) - -(-len(w) * 2 // 3) + trial % 2))
        doc = []
        for j, x in enumerate(w):
            if j not in lost:
                doc.append(x)
            elif rng.random() < 0.5:
                doc.append("changed")
            if rng.random() < 0.15:
                doc.append("added")
        doc = ["before"] * 3 + doc + ["after"] * 2
        want = {k for k, t in items if slow_copy(t.split(), doc)} | {k for k, t in items if any(" ".join(t.split()[a : a + 12]) in " ".join(doc) for a in range(len(t.split()) - 11))}
        assert ix.leaks(" ".join(doc)) == want
        hits += i in want
    assert 15 <= hits < 40


def test_a_word_added_before_the_last_kept_word():
    w = ITEMS[2][1].split()  # 25 words, 17 to keep
    lost = [1, 4, 7, 10, 13, 16, 19, 22]
    copy = [x for i, x in enumerate(w) if i not in lost]
    assert 2 in LeakIndex(ITEMS).leaks(" ".join(copy[:-1] + ["added"] + copy[-1:]))


def test_blocks_give_what_one_gives(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "so " + t + " end") for i, t in ITEMS] + [(9, None), (10, "")], "doc_id long, text string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    one = sorted(map(tuple, find_leaks(docs, items).collect()))
    monkeypatch.setattr(leakage, "BLOCK", 2)
    assert sorted(map(tuple, find_leaks(docs, items).collect())) == one and len(one) == len(ITEMS)
