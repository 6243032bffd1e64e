import random

import pytest

from loomlog.llm import encoding, mixing, splitting, tokenizers
from loomlog.tables import stored, table

D = "/root/testdata/sf0.001"
ALPHABET = "ab1 .\n\t\r'sΣé  \x1c\x1d​İßЖ中\U0001f600<|endoftext|>"
random.seed(1)
ODD = ["".join(random.choice(ALPHABET) for _ in range(random.randrange(1, 40))) for _ in range(3000)]
ODD += ["", " ", "a" * 5000, " " * 3000, "\n" * 999 + "x", "<|endoftext|>", "ab" * 3000, " a", "a ", "a  b", "a \n b", "don't I'LL", "Å", "x  y"]


@pytest.fixture(scope="module")
def texts(spark):
    return [r.text for r in table(spark, "/root/testdata/sf0.01", "documents").select("text").collect() if r.text] + ODD


@pytest.mark.parametrize("name, file", [("byte_bpe_50k", "byte_bpe_50k.json"), ("word_bpe_49k", "word_bpe_49k.json")])
def test_same_ids_as_the_library(texts, name, file):
    library = pytest.importorskip("tokenizers").Tokenizer.from_file(f"{tokenizers.FOLDER}/{file}")
    library.encode_special_tokens = True
    mine = tokenizers.load(name)
    for text, want in zip(texts, library.encode_batch(texts, add_special_tokens=False)):
        assert mine.encode(text) == want.ids, repr(text[:80])
        assert mine.count(text) == len(want.ids)
    assert mine.encode(None) == mine.encode("") == [] and mine.count(None) == 0


def test_chunks_are_independent(texts):
    for name in ("byte_bpe_50k", "word_bpe_49k"):
        t = tokenizers.load(name)
        for text in texts[-3000:]:
            assert sum(t.chunk_counts(tokenizers.CHUNK.findall(text))) == len(t.encode(text))
            assert all(t.count(text) <= sum(map(t.most, text)) for _ in (1,))


def test_long_words_merge_alike(monkeypatch):
    t = tokenizers.load("byte_bpe_50k")
    words = ["internationalization" * 8, "abababab" * 20, "中文" * 30, "x" * 333]
    want = [t._word(w) for w in words]
    monkeypatch.setattr(tokenizers, "LONG", 3)
    assert [t._word(w) for w in words] == want


def test_forgetting_changes_nothing(monkeypatch, texts):
    t = tokenizers.ByteBPE(f"{tokenizers.FOLDER}/byte_bpe_50k.tiktoken")
    want = [t.encode(x) for x in texts[:50]]
    monkeypatch.setattr(tokenizers, "REMEMBERED", 5)
    assert [t.encode(x) for x in texts[:50]] == want


def test_ids_of_documents(spark):
    rows = [(1, None), (2, ""), (3, "Hello world"), (3, "Hello world"), (4, "<|endoftext|>")]
    got = [(r.doc_id, list(r.ids)) for r in encoding.ids(spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as ids")).collect()]
    assert got == [(1, []), (2, []), (3, [15496, 995]), (3, [15496, 995]), (4, tokenizers.load("byte_bpe_50k").encode("<|endoftext|>"))] and 50256 not in got[-1][1]
    assert encoding.ids(spark.createDataFrame([], "doc_id long, text string")).count() == 0


LIMITS = [("s", "byte_bpe_50k", 128, 16), ("m", "byte_bpe_50k", 512, 64), ("l", "byte_bpe_50k", 2048, 0), ("w", "word_bpe_49k", 256, 32), ("tiny", "byte_bpe_50k", 8, 3), ("most", "byte_bpe_50k", 40, 30), ("more", "word_bpe_49k", 64, 48)]
LONG_TEXTS = ["".join(random.choice(ALPHABET[:20]) for _ in range(random.randrange(1, 3000))) for _ in range(40)] + ["".join(chr(0x4E00 + i % 2000) for i in range(3000)), "Q9" * 3000, "x" * 10 + " " * 5000 + "y", "word " * 3000, "A. " * 900]


@pytest.mark.parametrize("limit", LIMITS, ids=lambda x: x[0])
def test_pieces(texts, limit):
    _, name, most, overlap = limit
    t = tokenizers.load(name)
    for text in [x for x in texts[:300] + ODD[-14:] + LONG_TEXTS if x]:
        found = splitting.pieces(t, text, most, overlap)
        assert found[0][0] == 0 and found[-1][1] == len(text)
        assert len(found) == 1 or t.count(text) > most
        for i, (a, b, n) in enumerate(found):
            assert n == t.count(text[a:b]) <= most
            if i:
                before = found[i - 1]
                assert before[0] < a <= before[1] < b


def test_natural_places_and_overlap():
    t = tokenizers.load("byte_bpe_50k")
    text = " ".join(f"Sentence number {i} ends here." for i in range(200))
    found = splitting.pieces(t, text, 64, 8)
    assert all(text[:b].endswith(".") for _, b, _ in found)
    assert all(t.count(text[b[0] : a[1]]) >= 8 for a, b in zip(found, found[1:]))
    greedy, at = [], 0
    while True:  # one piece after another
        rest = splitting.pieces(t, text[at:], 64, 8)
        greedy.append((at, at + rest[0][1]))
        if len(rest) == 1:
            break
        at += rest[1][0]
    assert greedy == [(a, b) for a, b, _ in found]


CJK = "入力更査会記録約行列。出新分要保話検存差"
BREAKLESS = [
    " ".join("".join(random.choice("abcdef0123456789/-_") for _ in range(random.randrange(60, 200))) for _ in range(40)), "".join(random.choice(CJK) for _ in range(4000)), "x" * 20_000, "internationalization" * 300,
    "".join(random.choice("abcdefghij") for _ in range(9000)), "=" * 9000 + "'s", "!?'ll" * 900, "e\u0301a\u0308" * 2000, "İ" * 900, "สวัสดีชาวโลก" * 300, "한글" * 900, "\u1112\u1161\u11ab" * 500, "a" + "\u0301" * 900, "\U0001f600" * 900, ('{"a":[1,2,{"b":"c"}]},' * 9 + " ") * 30,
]


@pytest.mark.parametrize("limit", LIMITS, ids=lambda x: x[0])
def test_overlap_of_all_texts(texts, limit):
    _, name, most, overlap = limit
    t = tokenizers.load(name)
    for text in [x for x in texts[:300] + ODD[-14:] + LONG_TEXTS + BREAKLESS if x]:
        found = splitting.pieces(t, text, most, overlap)
        assert found[0][0] == 0 and found[-1][1] == len(text)
        for before, (a, b, n) in zip(found, found[1:]):
            assert n == t.count(text[a:b]) <= most and before[0] < a <= before[1] < b
            assert most < 32 or t.count(text[a : before[1]]) >= overlap, (text[:40], before, a, b)  # a few characters may have 8 tokens


def test_breakless_texts_fill_their_pieces():
    t = tokenizers.load("byte_bpe_50k")
    for text in BREAKLESS[2:5]:
        found = splitting.pieces(t, text, 128, 16)
        assert all(n >= 120 for _, _, n in found[:-1]) and all(16 <= t.count(text[b[0] : a[1]]) <= 24 for a, b in zip(found, found[1:]))


def test_split_documents(spark):
    rows = [(1, None), (2, ""), (3, "short"), (4, "many words " * 400), (5, "Q9" * 3000)]
    got = splitting.split(spark.createDataFrame(rows, "doc_id long, text string"), LIMITS).collect()
    by = {}
    for r in got:
        by.setdefault((r.doc_id, r.limit_name), []).append(r)
    texts = dict(rows)
    assert set(by) == {(d, x[0]) for d in (3, 4, 5) for x in LIMITS}
    for (doc, name), pieces in by.items():
        pieces.sort(key=lambda r: r.piece_no)
        _, tokenizer, most, overlap = next(x for x in LIMITS if x[0] == name)
        assert [r.piece_no for r in pieces] == list(range(1, len(pieces) + 1))
        assert [(r.start_char, r.end_char, r.n_tokens) for r in pieces] == splitting.pieces(tokenizers.load(tokenizer), texts[doc], most, overlap)
        assert all(r.text == texts[doc][r.start_char : r.end_char] for r in pieces)


@pytest.mark.parametrize("most, overlap", [(40, 40), (40, 41), (40, -1), (0, 0)])
def test_an_overlap_that_cannot_be_met_is_refused(spark, most, overlap):
    with pytest.raises(ValueError):
        splitting.split(spark.createDataFrame([(1, "x")], "doc_id long, text string"), [("l", "byte_bpe_50k", most, overlap)])


def sizes(spark, n, sources="abc"):
    r = random.Random(7)
    rows = [(i, random.Random(i).choice(sources), r.randrange(1, 400)) for i in range(n)] + [(n, None, 50), (n + 1, "a", 0), (n + 2, "unnamed", 500)]
    return spark.createDataFrame(rows, "doc_id long, source string, n_tokens long")


TARGETS = "mix_name string, source string, target_share double, max_repeat long, total_ratio double"


def test_mix_meets_its_goals(spark, monkeypatch):
    monkeypatch.setattr(mixing, "FAN_IN", 2)
    monkeypatch.setattr(mixing, "TASK_ROWS", 400)
    monkeypatch.setattr(mixing, "RESERVE", 20)
    df = stored(sizes(spark, 3000).repartition(7), "sizes")
    targets = spark.createDataFrame([("m", "a", 0.5, 2, 0.5), ("m", "b", 0.3, 3, 0.5), ("m", "gone", 0.2, 1, 0.5), ("n", "a", 0.9, 1, 2.0), ("n", "c", 0.1, 9, 2.0)], TARGETS)
    mixed, cells = mixing.mix(df, targets, stored)
    mixed = stored(mixed, "mixed")
    by = {(r.mix_name, r.source): r for r in mixing.shares(mixed, cells).collect()}
    for key in (("m", "a"), ("m", "b"), ("n", "c")):
        assert abs(by[key].used_tokens - by[key].goal_tokens) <= 3 and abs(by[key].goal_share - by[key].target_share) < 1e-4 and by[key].bound is None, key
    assert by["n", "a"].bound == "max_repeat" and by["m", "gone"].bound == "documents"
    assert by["n", "a"].used_tokens == by["n", "a"].available_tokens < by["n", "a"].goal_tokens and by["m", "gone"].used_tokens == 0 == by["m", "gone"].actual_share
    assert abs(sum(by[k].actual_share for k in by if k[0] == "m") - 1) < 1e-9
    caps = {(t.mix_name, t.source): t.max_repeat for t in targets.collect()}
    rows = mixed.collect()
    assert len({(r.mix_name, r.doc_id) for r in rows}) == len(rows) and all(1 <= r.uses <= caps[r.mix_name, r.source] for r in rows)
    whole = {c.source: c.uses for c in cells if c.mix_name == "n"}
    assert all(int(whole["c"]) <= r.uses <= int(whole["c"]) + 1 for r in rows if (r.mix_name, r.source) == ("n", "c"))
    again = mixing.mix(df, targets, stored)[0]
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, rows))
    moved = mixing.mix(stored(df.repartition(3, "n_tokens"), "moved"), targets, stored)[0]  # however the rows are stored
    assert sorted(map(tuple, moved.collect())) == sorted(map(tuple, rows))
    other = mixing.mix(df, targets, stored, seed=1)[0]
    assert sorted(map(tuple, other.collect())) != sorted(map(tuple, rows))


def test_rounding_is_fair():
    used = [0] * 20
    for seed in range(1500):
        pivot = mixing._Pivot((seed, "m", "s"))
        for doc in range(20):
            pivot.add(doc, 10 + doc * 7, 0, 0.3)
        for doc, _, _, p in pivot.done:
            used[doc] += int(p)
        if pivot.rest and mixing._draw(seed) < pivot.rest[3]:
            used[pivot.rest[0]] += 1
    assert all(0.24 < n / 1500 < 0.36 for n in used)


def test_what_is_settled_comes_near():
    r = random.Random(3)
    for seed in range(200):
        rows = [(i, r.randrange(1, 20_000), 0, r.choice([0.01, 0.3, 0.97])) for i in range(r.randrange(1, 70))]
        got = mixing.settled((seed, "m", "s"), rows)
        assert sorted(x[0] for x in got) == list(range(len(rows))) and {x[3] for x in got} <= {0.0, 1.0}
        miss = abs(sum(w * p for _, w, _, p in rows) - sum(w * p for _, w, _, p in got))
        assert miss <= max(w for _, w, _, _ in rows) / 2 + 1 and (len(rows) < 20 or miss <= 1)
    for _ in range(300):
        changes, goal = [r.randrange(-30, 31) for _ in range(r.randrange(9))], r.randrange(-60, 61)
        sums = {sum(x for i, x in enumerate(changes) if k >> i & 1) for k in range(1 << len(changes))}
        assert abs(sum(changes[i] for i in mixing.nearest(changes, goal)) - goal) == min(abs(x - goal) for x in sums)
    assert mixing.settled((1, "m", "s"), []) == []


def test_mix_of_nothing(spark):
    none = stored(sizes(spark, 0).where("false"), "none")
    targets = spark.createDataFrame([("m", "a", 1.0, 2, 0.5)], TARGETS)
    mixed, cells = mixing.mix(none, targets, stored)
    assert mixed.count() == 0 and mixing.shares(mixed, cells).first().actual_share == 0.0
    assert mixing.mix(stored(sizes(spark, 5), "few"), targets.where("false"), stored)[0].count() == 0
