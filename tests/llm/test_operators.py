"""Every operator against a brute-force version on small tables with awkward rows."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from markloom.llm import _text, chat, components, exact, hyperminhash, licenses, mixing, pieces, quality, sharding, substring, token_files
from markloom.llm.queries import tokenizer_path

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def corpus() -> list[tuple]:
    rng = random.Random(7)
    vocab = ["w%d" % i for i in range(400)] + ["the", "of", "and", "Über", "ñandú", "漢字", "𝒳y"]
    base = [" ".join(rng.choices(vocab, k=rng.randint(1, 120))) for _ in range(60)]
    passage = " ".join(rng.choices(vocab, k=45))
    rows = [t if i % 3 else f"{t}\n{passage}. {t[:50]}" for i, t in enumerate(base)]
    rows += [base[5]] * 6 + [base[6].upper(), base[6].lower()]
    for i in range(40):
        w = base[7].split() + base[8].split()
        for _ in range(rng.randint(0, 5)):
            w[rng.randrange(len(w))] = rng.choice(vocab)
        rows.append(" ".join(w))
    rows += [None, "", " \t\n ", "one", "two words", "a b c", "A B C", "x " * 6000, "###|| $$$ " * 30, "  two  spaces \n\n x\t\ty \n z \n", "\x1c odd spaces here \n \n and", "l1\nl1\nl2\n\nl1"]
    return [(i, t, "en", f"src{i % 7}" if i % 11 else None, len(t or "")) for i, t in enumerate(rows)]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5).selectExpr("*", "'clash' AS size", "1 AS shard", "'x' AS body").cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def words(t):
    return WORD.findall(t or "")


def test_word_hashes_tell_words_apart():
    import pyarrow as pa

    texts = ["alpha beta", None, "beta", "alphabeta", "x" * 5000 + " beta"]
    got = []
    for _, _, w in _text.chunks(pa.array(texts)):
        h = w.hashes()
        got += [h[w.first[i] : w.first[i + 1]].tolist() for i in range(len(w.first) - 1)]
    assert got[0][1] == got[2][0] == got[4][1] and len({x for g in got for x in g}) == 4 and got[1] == []


def test_quality(docs, rows, none):
    got = {r.doc_id: r for r in quality.score(docs, ["doc_id"]).collect()}
    for i, t, *_ in rows:
        w, r = words(t), got[i]
        ls = [x for x in (t or "").split("\n") if WORD.search(x)]
        win = [tuple(w[k : k + 5]) for k in range(len(w) - 4)]
        c = Counter(win)
        covered = {p for k, x in enumerate(win) if c[x] > 1 for p in range(k, k + 5)}
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (
            len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(ls) - len(set(ls)), len(covered),
        ), t
        assert r.base_failed == (len(w) < 10 or 100 * len(covered) > 20 * len(w))
        assert not (r.base_failed and r.kept)
    assert quality.score(none, ["doc_id"]).count() == 0
    kept = quality.filter_documents(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if r.kept}


def test_exact(docs, rows, none, spark):
    groups = defaultdict(list)
    for i, t, *_ in rows:
        groups[(t or "").translate(LOWER)].append(i)
    got = {r.doc_id: r for r in exact.classes(docs).collect()}
    assert len(got) == len(rows)
    for text, ids in groups.items():
        for i in ids:
            r = got[i]
            assert (r.keep_id, r.group_size, r.kept, r.text_sha256) == (max(ids), len(ids), i == max(ids), hashlib.sha256(text.encode()).hexdigest())
    assert exact.classes(none).count() == 0
    assert sorted(r.doc_id for r in exact.drop_copies(docs).collect()) == sorted(max(v) for v in groups.values())
    # few bits: most rows are suspected, the bytes still decide
    rough = {r.doc_id: r.keep_id for r in exact.classes(docs, fingerprint_bits=4, owners=3).collect()}
    assert rough == {i: r.keep_id for i, r in got.items()}
    odd = spark.createDataFrame([(None, "q"), (1, "q"), (1, "q"), (None, "only"), (2, None), (3, "")], "doc_id long, text string")
    seen = sorted(((r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact.classes(odd).collect()), key=str)
    assert seen == sorted([(None, 1, 3, False), (1, 1, 3, True), (1, 1, 3, True), (None, None, 1, True), (2, 3, 2, False), (3, 3, 2, True)], key=str)


def test_golomb_roundtrip():
    rng = np.random.default_rng(3)
    for n, top in ((0, 10), (1, 1 << 50), (1000, 1 << 40), (500, 600)):
        v = np.unique(rng.integers(0, top, n, dtype=np.uint64))
        rice, high, low = exact.golomb_encode(v)
        assert (exact.golomb_decode(len(v), rice, high, low) == v).all()


def brute_substring(rows, size=20):
    seen, out = set(), {}
    for i, t, *_ in sorted(rows, key=lambda r: r[0]):
        w, gone = words(t), set()
        for k in range(len(w) - size + 1):
            g = tuple(w[k : k + size])
            if g in seen:
                gone.update(range(k, k + size))
            seen.add(g)
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out[i] = (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


@pytest.mark.parametrize("group", [1 << 21, 64])
def test_substring(docs, rows, none, monkeypatch, group):
    monkeypatch.setattr(substring, "GROUP_WINDOWS", group)
    parsed = substring.parse(docs).collect()
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in parsed}
    assert got == brute_substring(rows)
    text = {r[0]: words(r[1]) for r in rows}
    for r in parsed:
        covered, last = set(), (-1, -1)
        for f in r.factors:
            here, there = (text[i][s : s + f.length] for i, s in ((r.doc_id, f.start), (f.source, f.source_start)))
            assert here == there and len(here) == f.length >= 20 and (f.source, f.source_start) < (r.doc_id, f.start) and last < (f.start, f.start + f.length)
            last = (f.start, f.start + f.length)
            covered.update(range(f.start, f.start + f.length))
        assert covered == {p for a, b in r.spans for p in range(a, b)} and len(covered) == r.n_removed
    assert substring.parse(none).count() == 0


def distinct_rows():
    return [(i, " ".join(f"u{i}x{k}" for k in range(30)), "en", "s", 0) for i in range(7)]


@pytest.mark.parametrize("parts", [1, 2, 7])
def test_substring_on_small_tables(spark, parts):
    one = [(4, " ".join(f"v{k}" for k in range(50)), "en", "s", 0)]
    tables = [one, [(0, "a b c", "en", "s", 3)], [(i, None, None, None, 0) for i in range(3)], distinct_rows(), [(0, "x " * 60, "en", "s", 120)], [*distinct_rows(), (9, "", "en", "s", 0), (10, distinct_rows()[0][1], "en", "s", 0)]]
    for rows in tables:
        table = spark.createDataFrame(spark.sparkContext.parallelize(rows, parts), SCHEMA)
        got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring.parse(table).collect()}
        assert got == brute_substring(rows), rows
    nulls = spark.createDataFrame([(None, one[0][1]), (None, one[0][1]), (3, one[0][1])], "doc_id long, text string").repartition(parts)
    assert [r.n_removed for r in substring.parse(nulls).collect()] == [0, 0, 0]


def test_substring_survives_a_clash_of_hashes(spark, docs, rows, monkeypatch):
    plain = substring._index

    def clashing(size, anchor, slots, salt):
        if salt:
            return plain(size, anchor, slots, salt)

        def run(batches):
            # all windows under one anchor look alike
            names, inner = plain.__globals__, _text.grams
            names["grams"] = lambda h, k: inner(h, k) & np.uint64(0) if k == size else inner(h, k)
            try:
                yield from plain(size, anchor, slots, salt)(batches)
            finally:
                names["grams"] = inner

        return run

    monkeypatch.setattr(substring, "_index", clashing)
    salts = []
    cuts = substring._cuts
    monkeypatch.setattr(substring, "_cuts", lambda *a: salts.append(a[-1]) or cuts(*a))
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring.parse(docs).collect()}
    assert got == brute_substring(rows) and salts == [0, 1]


def brute_links(rows, k, percent):
    sets = {}
    for i, t, *_ in rows:
        w = words((t or "").translate(LOWER))
        sets[i] = {tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))} if w else set()
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                    x, y = root(a), root(b)
                    up[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in ids}


@pytest.mark.parametrize(("k", "percent"), [(3, 85), (5, 80)])
def test_near(docs, rows, none, k, percent):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in hyperminhash.link(docs, shingle=k, percent=percent).collect()}
    assert got == brute_links(rows, k, percent)
    assert hyperminhash.link(none).count() == 0


def test_hyperminhash_estimate():
    rng = np.random.default_rng(5)
    for share in (0.2, 0.5, 0.9):
        a = rng.integers(0, 1 << 63, 4000, dtype=np.uint64)
        b = a.copy()
        new = round(4000 * (1 - share) / (1 + share))
        b[:new] = rng.integers(0, 1 << 63, new, dtype=np.uint64)
        regs = [hyperminhash.registers(np.zeros(len(x), np.int64), np.unique(x), 1) for x in (a, b)]
        got, _ = hyperminhash.estimate(*regs, np.array([4000]), np.array([4000]))
        assert abs(got[0] - share) < 0.17


def test_components(spark):
    rng = random.Random(1)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(60)]
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in pairs:
        if a != b:
            x, y = root(a), root(b)
            up[max(x, y)] = min(x, y)
    got = {r.id: r.component for r in components.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {x: root(x) for x in up}


def test_simple8b():
    rng = np.random.default_rng(1)
    cases = [rng.integers(0, 50257, 10003), np.zeros(0), np.array([2]), rng.integers(0, 1 << 63, 999, dtype=np.uint64) * np.uint64(2) + np.uint64(1), np.array([(1 << 64) - 1, 3, (15 << 60) + 5, (1 << 60) - 1, 0], np.uint64)]
    for ids in cases:
        ids = np.asarray(ids).astype(np.uint64)
        offsets, packed = token_files.pack(ids)
        assert (token_files.unpack(len(ids), packed) == ids).all()
        assert (token_files.unpack(len(ids), packed, offsets) == ids).all()
        if len(offsets) > 3:
            part = ids[token_files.LANE : 3 * token_files.LANE]
            assert (token_files.unpack(len(part), packed[offsets[1] : offsets[3]], offsets[1:4]) == part).all()
        # any lane is decoded from its offset alone
        for k in range(len(offsets) - 1):
            part = ids[k * token_files.LANE : (k + 1) * token_files.LANE]
            assert (token_files.unpack(len(part), packed[offsets[k] : offsets[k + 1]]) == part).all()


def test_token_files(docs, rows, none, spark):
    from tokenizers import Tokenizer

    path = tokenizer_path("byte_bpe_50k.json")
    model = Tokenizer.from_file(path)
    assert model.encode("a <|endoftext|> b", add_special_tokens=False).ids == [64, 220, 50256, 275]
    more = [(900, "a\n \nb  c\n d"), (901, "x\n "), (902, "end\n"), (903, "\nstart\n\n mid <|endoftext|> z"), (904, " lead trail "), (905, "word. word, word.. é. 5. it's. a.\nb. X, don't, .. , ."), (906, "end."), (907, "a.b. c.,"), (908, "a <|endoftext|> b"), (909, "<|endoftext|><|endoftext|>x <|endoftext|>")]
    table = docs.select("doc_id", "text").union(spark.createDataFrame(more, "doc_id long, text string"))
    got = {r.doc_id: tuple(r) for r in token_files.roundtrip(table, path).collect()}
    at = 0
    for i, t in sorted([r[:2] for r in rows] + more):
        ids = [*model.encode(t or "", add_special_tokens=False).ids, 2]
        assert got[i] == (i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())), t
        at += len(ids)
    assert token_files.roundtrip(none, path).count() == 0


def test_packing_tree():
    rng = random.Random(2)
    items = [(rng.randint(1, 100), k) for k in range(2000)]
    placed = sharding.best_fit_decreasing(items, 100)
    # the plain quadratic version
    rooms, want = [], {}
    for size, k in sorted(items, key=lambda x: (-x[0], str(x[1]))):
        fit = min(((r, b) for b, r in enumerate(rooms) if r >= size), default=None)
        if fit is None:
            rooms.append(100)
            fit = (100, len(rooms) - 1)
        rooms[fit[1]] -= size
        want[k] = fit[1]
    assert placed == want


def test_sharding(docs, rows, none):
    got = {r.doc_id: r for r in sharding.shard(docs, 6).collect()}
    assert len(got) == len(rows)
    slots, bytes_ = defaultdict(list), Counter()
    for i, t, *_ in rows:
        raw = (t or "").encode()
        assert (got[i].size, got[i].text_crc32) == (len(raw) + 16, zlib.crc32(raw))
        slots[got[i].shard].append(got[i].slot)
        bytes_[got[i].shard] += len(raw) + 16
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    same = defaultdict(set)
    for i, t, *_ in rows:
        same[t or ""].add(got[i].shard)
    assert all(len(v) == 1 for v in same.values())
    assert sharding.shard(none, 6).count() == 0


def test_sharding_cuts_a_hot_group(spark):
    rows = [(i, "same text " * 20) for i in range(3000)] + [(10000 + i, f"t{i} " * 30) for i in range(6000)]
    got = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string"), 10).toPandas()
    sizes = got.groupby("shard")["size"].sum()
    assert len(sizes) == 10 and sizes.max() < 1.03 * sizes.mean() and sizes.min() > 0.9 * sizes.mean()


def test_pfair_stays_within_a_block():
    weights = {"a": 5, "b": 3, "c": 1, "d": 7, "e": 1}
    span, done = sum(weights.values()), Counter()
    order = mixing.pfair_round(weights)
    assert Counter(s for s, _ in order) == weights
    for t, (s, j) in enumerate(order, 1):
        assert j == done[s]
        done[s] += 1
        assert all(abs(done[x] - t * w / span) < 1 for x, w in weights.items())


def test_mixing(docs, rows, none, spark):
    weights = {"src0": 3, "src1": 1, "src2": 2}
    got = sorted(mixing.schedule(docs, weights, other=2, block_rows=4).collect(), key=lambda r: r.position)
    assert [r.position for r in got] == list(range(len(rows))) and {r.doc_id for r in got} == {r[0] for r in rows}
    own = {r[0]: r[3] if r[3] in weights else mixing.OTHER for r in rows}
    by = defaultdict(list)
    for i in own:
        by[own[i]].append(i)
    for s in by:
        by[s].sort(key=lambda i: (hashlib.md5(str(i).encode()).hexdigest(), i))
    all_weights = {**weights, mixing.OTHER: 2}
    left = {s: -(-len(v) // 4) for s, v in by.items()}
    blocks = {s: [v[k : k + 4] for k in range(0, len(v), 4)] for s, v in by.items()}
    want, begun = [], Counter()
    while left:
        active = {s: all_weights[s] for s in left}
        full = all(left[s] >= w for s, w in active.items())
        for s, j in mixing.pfair_round(active):
            if full or j < left[s]:
                want += blocks[s][begun[s] + j]
        for s, w in active.items():
            n = min(w, left[s])
            begun[s] += n
            left[s] -= n
        left = {s: n for s, n in left.items() if n}
    assert [r.doc_id for r in got] == want
    mixed = mixing.mix(docs, weights, other=2, block_rows=4)
    assert mixed.columns == docs.columns and [r.doc_id for r in mixed.collect()] == want
    assert mixing.schedule(none).count() == 0 and mixing.mix(none).count() == 0


def brute_path(w, m):
    best = [(0.0, 0, [])]
    for e in range(1, len(w) + 1):
        ways = []
        for s in range(max(0, e - m.longest), e):
            x = w[s:e]
            g = m.pieces.get(x) if s == 0 or x[0] != pieces.MARK else None
            if g:
                ways.append((best[s][0] + g[1], s, [g[0]]))
            elif e - s == 1:
                ways.append((best[s][0] + pieces.BYTE_SCORE * len(x.encode()), s, [m.byte_ids[b] for b in x.encode()]))
        best.append(max(ways))
    e, out = len(w), []
    while e:
        out = best[e][2] + out
        e = best[e][1]
    return out


def test_pieces(docs, rows, none, spark):
    import pyarrow as pa
    import sentencepiece

    path = tokenizer_path("piece_bpe_32k.model")
    m = pieces.Model.of(path)
    texts = [r[1] for r in rows] + ["▁▁ a▁b", "\n", " ", "\n x", "line\nline"]
    names = sorted({pieces._marked(w) for w in pieces._cut(pa.array([t or "" for t in texts]))[0].to_pylist() if len(w) < 3000})
    want = [brute_path(w, m) for w in names]
    assert pieces.encode_words(names, m) == want
    told = {r.word: list(r.ids) for r in pieces.word_ids_relational(spark.createDataFrame([(w,) for w in names], "word string"), path).collect()}
    assert told == dict(zip(names, want, strict=True))
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    known = sentencepiece.SentencePieceProcessor(model_file=path)
    for r in pieces.encode(table, path, with_ids=True).collect():
        assert r.exact and r.n_pieces == len(r.ids), texts[r.doc_id]
        if pieces.MARK not in (texts[r.doc_id] or ""):
            assert known.decode(list(r.ids)) == (texts[r.doc_id] or "")
    assert pieces.encode(none, path).count() == 0


def test_quotation_links(spark):
    rows = [
        (1, 0, "user", "Hello there, how does one fold a map?\nThanks in advance for help."),
        (1, 1, "assistant", "> Hello there,  how does ONE fold a map?\n\nYou crease it along the old lines."),
        (1, 2, "user", "Something else entirely, unrelated."),
        (1, 3, "user", ">> Thanks in advance for help.\n> You crease it along the old lines.\nThat worked, many thanks."),
        (1, 4, "assistant", "> not said by anybody in this place\nodd"),
        (2, 0, "user", None),
        (2, 0, "user", ""),
        (None, 1, "user", "> x"),
        (2, 5, "user", "> Hello there, how does one fold a map?"),
    ]
    got = chat.link(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "0 AS rank")).collect()
    assert len(got) == len(rows)
    one = sorted((r for r in got if r.conv_id == 1), key=lambda r: r.position)
    assert [(r.turn, r.parent_turn, r.root_turn, r.n_quotes, r.n_linked) for r in one] == [(0, None, 0, 0, 0), (1, 0, 0, 1, 1), (3, 1, 0, 2, 2), (2, None, 2, 0, 0), (4, None, 4, 1, 0)]
    assert one[2].own_text == "That worked, many thanks."
    assert sorted((r.turn, r.position, r.own_text) for r in got if r.conv_id == 2) == [(0, 0, ""), (0, 1, ""), (5, 2, "")]
    assert chat.link(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_license_scan(spark):
    mit = licenses.TEMPLATES[3][1]
    texts = [
        "Prose first.\nLicensed under the Apache License, Version 2.0.\nMore prose.",
        "This work is licensed under the GNU General Public License, version 3.",
        "This work is licensed under the GNU General Public License, version 2.",
        "Licensed under CC BY-NC 4.0.",
        "Licensed under CC BY 4.0.",
        "They lost their driving license on the way to the pub.",
        mit.replace("Software is furnished", "Software  is\nfurnished") + "\n\nTHE END",
        "Copyright 2019 Jane Doe and others. All rights reserved.",
        None, "", "x " * 5000,
    ]
    want = [["Apache-2.0"], ["GPL-3.0"], ["GPL-2.0"], ["CC-BY-NC-4.0"], ["CC-BY-4.0"], [], ["MIT"], ["All-Rights-Reserved"], [], [], []]
    got = {r.doc_id: [n["license"] for n in r.notices] for r in licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [got[i] for i in range(len(texts))] == want


def test_pipeline(docs, rows, spark, tmp_path):
    import corpus_pipeline

    docs.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    kept = {r.doc_id for r in quality.filter_documents(docs).collect()}
    left = [r for r in rows if r[0] in kept]
    last = {}
    for r in left:
        last[(r[1] or "").translate(LOWER)] = max(r[0], last.get((r[1] or "").translate(LOWER), -1))
    left = [r for r in left if r[0] in set(last.values())]
    near = brute_links(left, 5, 80)
    left = [r for r in left if near[r[0]][1] == r[0]]
    assert {r.doc_id for r in got} == {r[0] for r in left} and all(r.exact for r in got)


def test_pipeline_shows_the_mix(docs, rows, spark, tmp_path, monkeypatch):
    import corpus_pipeline

    docs.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    own = {r[0]: r[3] for r in rows}

    def order():
        got = sorted(corpus_pipeline.run(spark, str(tmp_path)).collect(), key=lambda r: r.position)
        assert [r.position for r in got] == list(range(len(got)))
        left = spark.createDataFrame([(r.doc_id, own[r.doc_id]) for r in got], "doc_id long, source string")
        want = sorted(mixing.schedule(left).collect(), key=lambda r: r.position)
        assert [(r.doc_id, r.slot, r.position) for r in got] == [(r.doc_id, r.slot, r.position) for r in want]
        return [r.doc_id for r in got]

    first = order()
    monkeypatch.setattr(mixing, "TARGETS", {"src0": 1, "src5": 9})
    second = order()
    assert sorted(first) == sorted(second) and first != second


def prose(chars, seed=3):
    rng = random.Random(seed)
    vocab = "the of and river stone market said went over under while permission license work house software any all rights".split()
    return " ".join(rng.choices(vocab, k=chars))[:chars]


@pytest.mark.parametrize("chars", [300, 1000, 3000, 9000])
def test_license_inside_a_long_line(chars):
    scanner = licenses.Scanner()
    for k, (name, text) in enumerate(licenses.TEMPLATES):
        text = text.replace("<year>", "2019").replace("<holder>", "Jane Doe")
        line = f"Title\n{prose(chars // 2, k)}. {text} {prose(chars // 2, k + 50)}"
        got = [(n["line"], n["license"], n["covered"], n["differences"]) for n in scanner.scan(line)]
        assert got == [(1, name, 1.0, [])], (name, got)


def test_every_notice_of_a_block():
    scanner = licenses.Scanner()

    def got(text):
        return [(n["line"], n["license"]) for n in scanner.scan(text)]

    assert got("Copyright 2019 Jane Doe. All rights reserved.\nLicensed under the Apache License, Version 2.0.") == [(0, "All-Rights-Reserved"), (1, "Apache-2.0")]
    assert got("Licensed under CC BY 4.0. Released under the MIT License. Released under the MIT License.") == [(0, "CC-BY-4.0"), (0, "MIT"), (0, "MIT")]
    assert got("The copyright law is old. Copyright 2019 Jane Doe. All rights reserved.") == [(0, "All-Rights-Reserved")]
    names = [(0, name) for name, _ in licenses.TEMPLATES]
    texts = [t.replace("<year>", "2019").replace("<holder>", "Jane Doe") for _, t in licenses.TEMPLATES]
    for line in (" ".join(texts), f" {prose(300)} ".join(texts)):  # over 4000 characters: GPL-3.0-or-later and the long Apache text are whole
        assert got(line) == names
    assert got(texts[3].replace(" ", "\n")) == [(0, "MIT")]


def test_license_scan_finds_every_literal_notice(spark):
    from markloom.llm.queries import op9_license_scan

    rows = [(i, f"Some prose.\n{t}\nMore prose.") for i, (_, t) in enumerate(licenses.TEMPLATES) if "<" not in t]
    given = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()
    rows += [(1000 + r.doc_id, r.text) for r in given]
    want = {}
    for i, text in rows:
        found = []
        for k, line in enumerate((text or "").split("\n")):
            held = [(len(t), name) for name, t in licenses.TEMPLATES if t in line]  # a line of the tables has one at most
            found += [(k, max(held)[1])] if held else []
        want[i] = (len(found), ",".join(sorted({n for _, n in found})), ",".join(str(k) for k, _ in found), len(found))
    assert sum(w[1] == "All-Rights-Reserved" for i, w in want.items() if i >= 1000) > 0
    table = spark.createDataFrame(rows, "doc_id long, text string")
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr("markloom.llm.queries.table", lambda *_: table)
        got = {r.doc_id: (r.n_notices, r.licenses, r.lines, r.n_exact) for r in op9_license_scan(spark, "").collect()}
    assert got == want


def test_sharding_keeps_groups_under_a_shard_whole(spark):
    def placed(copies, others):
        rows = [(i, f"group {g} text " * 12) for g, n in enumerate(copies) for i in range(1000 * g, 1000 * g + n)]
        groups = {i: t for i, t in rows}
        rows += [(10**6 + i, f"t{i:05d} " * 20) for i in range(others)]
        got = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string"), 10).toPandas()
        assert len(got) == len(rows)
        mean = got["size"].sum() / 10
        at = defaultdict(set)
        for r in got.itertuples():
            if r.doc_id in groups:
                at[groups[r.doc_id]].add(r.shard)
        share = [n * (len(f"group {g} text " * 12) + 16) / mean for g, n in enumerate(copies)]
        return share, [len(v) for v in at.values()], got.groupby("shard")["size"].sum() / mean

    share, shards, sizes = placed([400], 4800)
    assert 0.75 < share[0] < 0.85 and shards == [1] and sizes.max() < 1.03 and sizes.min() > 0.9
    share, shards, sizes = placed([300] * 11, 2200)  # two of them must share a shard
    assert all(0.5 < s < 1 for s in share) and shards == [1] * 11 and sizes.max() < 2.05 * max(share)


def test_short_and_one_sentence_quotes(spark):
    rows = [
        (1, 0, "a", "Why not?"),
        (1, 1, "b", "It is late. The shop on the corner has closed already. We stay."),
        (1, 2, "a", "> Why not?\nBecause."),
        (1, 3, "a", "> The shop on the corner\n> has closed already.\nPity."),
        (1, 4, "b", "> we stay.\nGood."),
        (1, 5, "a", "你好吗？我很好。"),
        (1, 6, "b", "> 我很好。\n好"),
        (1, 7, "a", "> Nobody said so. The shop on the corner has closed already.\nYes."),
        (1, 8, "b", "> Never said. We stay.\nToo short a part of a passage."),
        (1, 9, "b", "> \n>\nEmpty quote."),
        (2, 1, "a", "> Why not?\nOther conversation."),
    ]
    got = chat.link(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    parents = {(r.conv_id, r.turn): r.parent_turn for r in got}
    assert parents == {(1, 0): None, (1, 1): None, (1, 2): 0, (1, 3): 1, (1, 4): 1, (1, 5): None, (1, 6): 5, (1, 7): 1, (1, 8): None, (1, 9): None, (2, 1): None}


@pytest.mark.parametrize("group", [1 << 21, 16])
@pytest.mark.parametrize("parts", [1, 2])
def test_substring_repeated_rows(spark, monkeypatch, parts, group):
    monkeypatch.setattr(substring, "GROUP_WINDOWS", group)
    one, two, three = (" ".join(f"{x}{i}" for i in range(30)) for x in "abc")
    texts = [(1, one), (2, f"{two} x {two}"), (3, f"{one} {three}"), (5, f"{three} y"), (5, f"z {three} {three}"), (6, f"q {two} {three}")]
    rows = [r for r in texts for _ in range(2)]  # one of each in each of two partitions
    got = Counter()
    table = spark.createDataFrame(spark.sparkContext.parallelize(rows[::2] + rows[1::2], parts), "doc_id long, text string")
    for r in substring.parse(table).collect():
        got[r.doc_id, r.n_words, r.n_removed, r.kept_sha256] += 1
    want = Counter()
    for i, text in rows:
        before = {tuple(words(t)[k : k + 20]) for j, t in rows if j < i for k in range(len(words(t)) - 19)}
        w, gone = words(text), set()
        for k in range(len(w) - 19):
            if tuple(w[k : k + 20]) in before:
                gone.update(range(k, k + 20))
            before.add(tuple(w[k : k + 20]))
        want[i, len(w), len(gone), hashlib.sha256(" ".join(x for k, x in enumerate(w) if k not in gone).encode()).hexdigest()] += 1
    assert got == want


def brute_threads(rows):
    """(conv_id, turn) -> (parent, root), and each conversation's turns in reply order."""

    def norm(t):
        return re.sub(r"\s+", " ", t.lower()).strip()

    def units(t, least):
        blocks = [norm(b) for b in re.split(r"\n\s*\n", t) + t.split("\n")]
        parts = blocks + [x.strip() for b in blocks for x in re.split(r"(?<=[.!?]) +", b)]
        return {x for x in [norm(t)] if x} | {x for x in parts if len(x) >= least}

    def read(text):
        runs = []
        for line in (text or "").split("\n"):
            m = re.match(r"(?:[ \t]*>)+", line)
            level, body = (m[0].count(">"), re.sub(r"^[ \t]", "", line[m.end() :])) if m else (0, line)
            if runs and runs[-1][0] == level:
                runs[-1][1].append(body)
            else:
                runs.append((level, [body]))
        own = "\n".join("\n".join(b) for level, b in runs if not level).strip(" \t\n\r")
        return own, [(level, "\n".join(b)) for level, b in runs if level]

    parents, order = {}, {}
    for conv in {r[0] for r in rows}:
        mine = sorted((r[1], *read(r[3])) for r in rows if r[0] == conv)
        first = {}
        for turn, own, _ in mine:
            for u in units(own, 1):
                first.setdefault(u, turn)
        kids = defaultdict(list)
        for turn, _, quotes in mine:
            met = [(-level, first[u]) for level, q in quotes for u in units(q, chat.LEAST_CHARS) if first.get(u, turn) < turn]
            parents[conv, turn] = max(met)[1] if met else None
            kids[parents[conv, turn]].append(turn)
        out, left = [], list(reversed(kids[None]))
        while left:
            turn = left.pop()
            out.append(turn)
            left += reversed(kids[turn])
        order[conv] = out
    return parents, order


def test_threads_against_brute_force(spark):
    rng = random.Random(17)
    rows = []
    for conv in range(6):
        said = []
        for turn in range(60 if conv else 200):
            own = " ".join(rng.choices("alpha beta gamma delta river stone market".split(), k=rng.randint(1, 9))) + rng.choice([".", "?", "", ".\nSecond line of it here."])
            text = own
            if said and rng.random() < 0.85:
                # conversation 0 is a chain, 1 a star, the others anything
                k = len(said) - 1 if conv == 0 else 0 if conv == 1 else rng.randrange(len(said))
                text = "\n".join("> " + x for x in said[k].split("\n")) + "\n" + own
                if rng.random() < 0.3:
                    text = ">> " + said[rng.randrange(len(said))].split("\n")[0] + "\n" + text
            said.append(own)
            rows.append((conv, turn, "ab"[turn % 2], text))
    parents, order = brute_threads(rows)
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    linked = chat.link(table)
    got = linked.collect()
    assert {(r.conv_id, r.turn): r.parent_turn for r in got} == parents
    places = defaultdict(list)
    for r in sorted(got, key=lambda r: (r.conv_id, r.position)):
        places[r.conv_id].append(r.turn)
    assert places == order and any(o != sorted(o) for o in order.values())
    texts = {(r.conv_id, r.part): (r.n_messages, r.text) for r in chat.conversations(linked).collect()}
    own = {(r.conv_id, r.turn): r.formatted for r in got}
    assert texts == {(c, 0): (len(o), "\n".join(own[c, t] for t in o)) for c, o in order.items()}


def test_clashing_columns_of_pipeline_stages(spark, docs):
    odd = docs.selectExpr("*", "'a' AS _gone", "1 AS rep", "2 AS component", "3 AS anchor", "'k' AS key").limit(60)
    assert exact.drop_copies(odd).columns == odd.columns and hyperminhash.drop_near_copies(odd).columns == odd.columns
    assert substring.parse(odd).count() == odd.count() and licenses.scan(odd).count() == odd.count()
    assert token_files.roundtrip(odd, tokenizer_path("byte_bpe_50k.json")).count() == odd.count()
    assert pieces.encode(odd, tokenizer_path("piece_bpe_32k.model")).count() == odd.count()


def test_pipeline_of_an_empty_table(spark, none, tmp_path):
    import corpus_pipeline

    none.write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    assert licenses.scan(none).count() == 0


def test_shared_folder_is_required_on_a_cluster(spark, monkeypatch):
    from markloom.llm import _io

    class Context:
        master = "spark://somewhere"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            get = staticmethod(lambda *_: None)

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        _io.shared_dir(Session())


@pytest.mark.parametrize("width", [1, 2, 5, 9, 20, 80])
def test_wrapped_notices_are_found_in_prose(width):
    """Every template, wrapped at so many words, long ones with a word lost and one added, inside a paragraph of prose."""
    scanner, missed = licenses.Scanner(), []
    for k, (name, text) in enumerate(licenses.TEMPLATES):
        said = text.replace("<year>", "2019").replace("<holder>", "Jane Doe").split()
        if len(said) >= 30:
            del said[len(said) // 2]
            said.insert(len(said) // 3, "really")
        body = prose(600, k).split() + said + prose(600, k + 99).split()
        lines = "\n".join(" ".join(body[a : a + width]) for a in range(0, len(body), width))
        got = scanner.scan(lines)
        if [n["license"] for n in got] != [name]:
            missed.append((name, text[:40], [(n["license"], n["covered"]) for n in got]))
    assert len(missed) <= len(licenses.TEMPLATES) // 10, missed


def test_whole_licence_texts():
    paragraphs = [t for n, t in licenses.TEMPLATES if n == "MIT" and len(t) > 60]
    got = licenses.Scanner().scan("Copyright (c) 2020 Jane Doe\n\n" + "\n\n".join(paragraphs))
    assert [n["license"] for n in got] == ["MIT"] * 3 and [n["line"] for n in got] == [2, 4, 6]


@pytest.mark.parametrize("longest", [3_000, 200_000])
def test_forty_shards_are_near_equal(spark, longest):
    """Law ``bytes``: texts above a mean shard lie alone, all other shards are near the mean of the rest."""
    rng = random.Random(23)
    rows = [(i, ("w%d " % i * max(1, int(rng.paretovariate(1.2) * 8)))[:longest]) for i in range(12000)]
    rows += [(20_000 + i, "same text " * 40) for i in range(100)]
    got = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), 40).toPandas()
    size = got.groupby("shard")["size"].sum().sort_values(ascending=False).tolist()
    sizes = sorted(got["size"], reverse=True)
    assert len(got) == len(rows) and len(size) == 40 and (sizes[0] * 40 > sum(sizes)) == (longest > 3_000)
    alone, left = 0, sum(sizes)
    while sizes[alone] * (40 - alone) > left:
        left -= sizes[alone]
        alone += 1
    mean = left / (40 - alone)
    assert size[:alone] == sizes[:alone] and size[alone] <= 1.03 * mean and size[-1] >= 0.9 * mean
    assert len(set(got[got.doc_id >= 20_000]["shard"])) == 1
