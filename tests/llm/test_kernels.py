import functools
import itertools
import random
import zipfile

import numpy as np
import pytest

from archspan.llm import ann, crf, media, packing, pieces, quality, secrets, setsketch, shingles, wordbpe

TEXTS = ["", " ", "Hello world", "It's  the\tend.\nWe'll see 'tis 've 12 3a", "a" * 300, "É à ßtraße ΣΑΣ İx <|endoftext|> b", "中文 的 mixed テキスト 😀", "x\0y\x1cz\x85w", "é nfd", "''s 's's \"'re"]


def noise(seed, n, alphabet="abcdeABC éÉüΣıK  \n\t'.,!|*&%1234中文的😀▁", most=70):
    rng = random.Random(seed)
    return ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, most))) for _ in range(n)]


def test_word_ids_are_the_library_s():
    w = wordbpe.word_ids()
    texts = TEXTS + noise(1, 800)
    want = [x.ids for x in w.library.encode_batch(texts, add_special_tokens=False)]
    assert [np.frombuffer(x, "<u4").tolist() for x in w(texts)] == want


def brute_fullest(room, left):
    sums = {0}
    for x, n in left.items():
        for _ in range(n):
            sums |= {s + x for s in sums if s + x <= room}
    return max(sums)


def test_fullest_combination():
    rng = random.Random(2)
    for _ in range(200):
        left = {rng.randint(1, 20): rng.randint(1, 3) for _ in range(rng.randint(1, 6))}
        room = rng.randint(0, 40)
        got = packing.fullest(room, left, sorted(left, reverse=True))
        assert sum(x * n for x, n in got.items()) == brute_fullest(room, left) and all(n <= left[x] for x, n in got.items())


def test_patterns_use_each_length_as_often_as_it_occurs():
    rng = random.Random(3)
    counts = {x: rng.randint(1, 50) for x in rng.sample(range(1, 101), 60)}
    used = {}
    for bin_, times in packing.patterns(counts, 100):
        assert sum(x * m for x, m in bin_.items()) <= 100
        for x, m in bin_.items():
            used[x] = used.get(x, 0) + m * times
    assert used == counts and packing.patterns({}, 100) == []


def test_pieces_are_the_library_s_however_they_are_cut():
    import public_tokenizers
    import sentencepiece

    m, sp = pieces.pieces(), sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    texts = TEXTS + noise(4, 400) + ["thequickbrownfox" * 12, "中文的是一不了在" * 20]
    ids = m.encode(texts)
    assert [x.tolist() for x in ids] == sp.encode(texts)
    assert [m.decode(x.tolist()).decode() for x in ids] == [t.replace("▁", " ") for t in texts]
    for t in [*noise(5, 30, most=200), *texts[-2:], "the of and  it was  " * 30]:
        for chunk in (35, 60, 150):
            if t:
                assert by_chunks(m, t, chunk) == sp.encode(t)


def by_chunks(m, t, chunk, fan=3):
    """Ids of a text by transfers, a tree of products, states from the top down, and a trace of each chunk."""
    s = m.normal(t)
    n = max(1, len(s) // chunk)
    cuts = [len(s) * k // n for k in range(n + 1)]
    contexts = []
    for k in range(n):
        a, b = max(0, cuts[k] - m.most), min(len(s), cuts[k + 1] + m.most)
        contexts.append((s[a:b], cuts[k] - a, cuts[k + 1] - a))
    levels = [[m.transfer(*c, k == 0, k == n - 1) for k, c in enumerate(contexts)]]
    while len(levels[-1]) > 1:
        levels.append([functools.reduce(pieces.plus, levels[-1][i : i + fan]) for i in range(0, len(levels[-1]), fan)])
    states = [(None, pieces.best_end(levels[-1][0]))]
    for level in levels[-2::-1]:
        states = [x for i, (a, b) in enumerate(states) for x in pieces.settle(level[i * fan : (i + 1) * fan], a, b)]
    return [i for c, (left, right) in zip(contexts, states, strict=True) for i in m.trace(c[0], left, right, c[1], c[2])]


@pytest.fixture(scope="module")
def unigram(tmp_path_factory):
    """A unigram model of a few pieces with scores whose sums are exact, written by hand; nothing is trained."""
    from sentencepiece import sentencepiece_model_pb2

    kind = sentencepiece_model_pb2.ModelProto.SentencePiece
    m = sentencepiece_model_pb2.ModelProto()
    m.trainer_spec.model_type, m.trainer_spec.byte_fallback = 1, True
    m.normalizer_spec.name, m.normalizer_spec.remove_extra_whitespaces, m.normalizer_spec.add_dummy_prefix, m.normalizer_spec.escape_whitespaces = "identity", False, True, True
    m.pieces.add(piece="<unk>", score=0, type=kind.UNKNOWN)
    for b in range(256):
        m.pieces.add(piece=f"<0x{b:02X}>", score=0, type=kind.BYTE)
    rng = np.random.default_rng(9)
    words = {"▁", *"abcdé", "▁a", "▁ab", "▁abc", "ab", "abc", "bc", "bcd", "cd", "cda", "da", "dab", "aa", "aaa", "bb", "▁the", "abcd", "bcda"}
    for w in sorted(words):
        m.pieces.add(piece=w, score=-float(rng.integers(2000, 12000)) / 1024, type=kind.NORMAL)
    path = tmp_path_factory.mktemp("unigram") / "m.model"
    path.write_bytes(m.SerializeToString())
    return str(path)


def test_a_unigram_model_s_best_paths_are_the_library_s(unigram):
    import sentencepiece

    m, sp = pieces.Pieces(unigram), sentencepiece.SentencePieceProcessor(model_file=unigram)
    total = lambda ids: sum(m.score.get(m.text[i], 0.0) for i in ids) + m.lost * sum(m.text[i].startswith("<0x") and m.bytes.get(int(m.text[i][3:5], 16)) == i and int(m.text[i][3:5], 16) & 0xC0 != 0x80 for i in ids)  # noqa: E731 - a lead byte is an unknown character
    texts = [*noise(8, 150, "aabbccdé  xz\n", 90), "abcda" * 60, "a" * 200, " ab" * 50]
    assert [x.tolist() for x in m.encode(texts)] == [sp.encode(t) for t in texts]
    for t in texts:
        for chunk in (12, 40):
            if t:  # equal sums have many paths (a+aa, aa+a): the sum is the library's, and so is the text
                found = by_chunks(m, t, chunk)
                assert total(found) == total(sp.encode(t)) and m.decode(found).decode() == t
    plain = ["abcd" * 40, "the cdab é" * 20, " abc bcda" * 30]
    assert [by_chunks(m, t, 30) for t in plain] == [sp.encode(t) for t in plain]


def test_max_plus_product_is_associative():
    rng = np.random.default_rng(6)
    states = [[(0, i) for i in range(n)] for n in (2, 3, 4, 2)]
    a, b, c = ((states[i], states[i + 1], rng.integers(-9, 9, (len(states[i]), len(states[i + 1]))).astype(float)) for i in range(3))
    x, y = pieces.plus(pieces.plus(a, b), c), pieces.plus(a, pieces.plus(b, c))
    assert x[:2] == y[:2] and (x[2] == y[2]).all()


def test_png_round_trip_and_readers():
    for text in ["", "x" * 64, "x" * 65, "héllo", None]:
        payload, n = media.padded(text)
        assert len(payload) % 64 == 0 and len(payload) >= 64 and payload[:n] == (text or "").encode() and not any(payload[n:])
        image = media.to_png(payload)
        assert media.from_png(image) == payload and media.to_png(payload) == image
    broken = bytearray(image)
    broken[45] ^= 1
    with pytest.raises(ValueError):
        media.from_png(bytes(broken))
    with pytest.raises(ValueError):
        media.from_png(b"nothing")


def stored(folder, n, names=lambda i: f"id-{-i}"):
    """A folder with one archive of n members and its manifest."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    a = media._Archive(f"{folder}/archives")
    for i in range(n):
        a.add(f"{i:08d}-{i}-{names(i)}.png", bytes([i]) * i * 10)
    told = a.close()
    (folder / "manifest").mkdir()
    pq.write_table(pa.Table.from_pylist([dict(zip(media.MANIFEST.names, told, strict=True))], media.MANIFEST), folder / "manifest/part-0.parquet")
    (folder / "manifest/_SUCCESS").touch()
    return told


def test_archives_are_zip_files(tmp_path):
    path, _, n = stored(tmp_path, 5)
    with zipfile.ZipFile(path) as z:
        assert n == 5 and z.testzip() is None and z.read("00000003-3-id--3.png") == b"\3" * 30
    with open(path, "rb") as f:
        listed = media.directory(f, f.seek(0, 2))
    assert [x[3] for x in listed] == [f"{i:08d}-{i}-id-{-i}.png" for i in range(5)]
    reader = media.MediaReader({"folder": str(tmp_path), "range_bytes": "100"})
    rows = list(reader.read(media.Range(path, 0, 10**6)))
    assert rows[0]["id"].to_pylist() == ["0", "-1", "-2", "-3", "-4"]
    parts = reader.partitions()
    assert len(parts) > 1 and sum(b.num_rows for p in parts for b in reader.read(p)) == 5


class Flaky:
    """A file system whose files fail, or give damaged bytes, for the first reads."""

    def __init__(self, store, fail, damage):
        self.store, self.fail, self.damage, self.opened = store, fail, damage, 0

    def open_input_file(self, path):
        self.opened += 1
        return FlakyFile(self, self.store.open_input_file(path))


class FlakyFile:
    def __init__(self, top, file):
        self.top, self.file = top, file

    def __getattr__(self, name):
        return getattr(self.file, name)

    def read(self, n):
        if self.top.fail:
            self.top.fail -= 1
            raise OSError("gone")
        data = self.file.read(n)
        if self.top.damage and data[:4] == media.LOCAL:
            self.top.damage -= 1
            return data[:-1] + b"?"
        return data


@pytest.mark.parametrize(("fail", "damage", "well"), [(0, 0, True), (2, 0, True), (3, 2, True), (0, 3, True), (99, 0, False), (0, 99, False)])
def test_members_are_read_again_by_offset(tmp_path, monkeypatch, fail, damage, well):
    path, *_ = stored(tmp_path, 4, lambda i: "null" if i == 2 else "id-null" if i == 1 else f"id-{i}")
    monkeypatch.setattr(media, "READ_AHEAD", 1)
    monkeypatch.setattr(media.time, "sleep", lambda s: None)
    store = Flaky(media.filesystem(path)[0], fail, damage)
    monkeypatch.setattr(media, "filesystem", lambda uri: (store, uri))
    reader = media.MediaReader({"folder": str(tmp_path)})
    if not well:
        with pytest.raises(OSError):
            list(reader.read(media.Range(path, 0, 10**6)))
        return
    rows = [r for b in reader.read(media.Range(path, 0, 10**6)) for r in b.to_pylist()]
    assert [(r["id"], r["media"]) for r in rows] == [("0", b""), ("null", b"\1" * 10), (None, b"\2" * 20), ("3", b"\3" * 30)]


def test_secret_spans():
    key = "AKIA" + "ABCDEFGH1234"
    text = f"é password='hunter2hunter2' token=short {key} AKIASHORT {'0f' * 16} {'a' * 31} token=token: abcdefgh12"
    base, every = secrets.spans(text)
    assert [(secrets.KINDS[k], text[s:e]) for s, k, e in base] == [("assign", "password='hunter2hunter2"), ("access", key), ("hex", "0f" * 16)]
    assert all(x in every for x in base)
    random_ = "q7Zt9XvB2mKp4LsW8dRj6Yhc"
    assert secrets.written(secrets.spans(f"see {random_} now")[1]) == "random:4:28"
    for plain in ["internationalization-of-responsibilities", "550e8400-e29b-41d4-a716-446655440000", "d41d8cd98f00b204e9800998ecf8427E", "123456789012345678901234567890", ""]:
        assert [x for x in secrets.spans(plain)[1] if x[1] == 3] == []
    assert secrets.redacted(text).count("[REDACTED]") == 3 and secrets.redacted(None) is None and "password='[" in secrets.redacted(text)
    assert secrets.spans(None) == ([], [])


def test_quality_statistics_are_finite_and_trees_learn():
    assert np.isfinite([quality.statistics(t) for t in [*TEXTS, None, "|" * 9]]).all()
    assert len(quality.statistics("x")) == len(quality.STATISTICS)
    rng = np.random.default_rng(7)
    x = rng.normal(size=(600, 3))
    y = ((x[:, 0] > 0.2) ^ (x[:, 1] > 0)).astype(float)
    m = quality.grow(x, y)
    assert ((m.score(x) >= 0.5) == y).mean() > 0.97
    assert quality.grow(x[:0], y[:0]).score(x[:2]).tolist() == [0.5, 0.5]
    assert np.ptp(quality.grow(x, np.ones(600)).score(x)) == 0


def words_of(lang, rng, n):
    ends = {"a": ["ing", "ed", "ly"], "b": ["ción", "ado", "osa"]}[lang]
    return " ".join("".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(2)) + rng.choice(ends) for _ in range(n))


def test_crf_labels_and_blocks():
    rng = random.Random(8)
    texts = [words_of(lang, rng, 60) for lang in "ab" * 40]
    m = crf.train(texts, list("ab" * 40), 15)
    fresh = [words_of(lang, rng, 40) for lang in "ab" * 20]
    assert [x for x, _ in m.predict(fresh)] == list("ab" * 20)
    assert m.predict([None, "", "12 !"]) == [("und", 0.0)] * 3
    switched = words_of("a", rng, 30) + " " + words_of("b", rng, 30)
    runs = m.runs(switched)
    assert runs[0][2] == "a" and runs[-1][2] == "b" and m.moves[0, 0] > m.moves[0, 1]
    long = " ".join([switched] * 9)  # several blocks: the same marginals as in one
    w = crf.find_words([long, "x", "", long])
    many = m.label_words(w)
    old, crf.BLOCK = crf.BLOCK, 10_000
    try:
        one = m.label_words(w)
    finally:
        crf.BLOCK = old
    assert np.allclose(many, one, atol=1e-9) and np.allclose(many.sum(1), 1)
    assert crf.Crf([], (np.zeros(0, np.uint64), np.zeros(0, np.int64))).predict(["abc"]) == [("und", 0.0)]


def test_marginals_equal_those_over_all_label_paths():
    """All labellings of short texts, each weighed by the product of its emissions and transitions."""
    rng = random.Random(3)
    langs = ["a", "b"] * 30
    m = crf.train([words_of(x, rng, 30) for x in langs], langs, 8)
    m.labels, k = ["a", "b", "c"], 3  # a third label with weights of its own
    m.weights = np.concatenate([m.weights, m.weights[:, :1] * 0.4 - 0.02], 1)
    m.moves = np.random.default_rng(4).normal(size=(k, k))
    old = crf.BLOCK
    try:
        for crf.BLOCK in (2, 3, 128):
            for text in (words_of("a", rng, 1), words_of("a", rng, 4) + " " + words_of("b", rng, 3), words_of("b", rng, 6)):
                w = crf.find_words([text])
                owner, which = crf.features(w, m.lexicon)
                psi, trans = m.emit(owner, which, len(w.key))[w.number], np.exp(m.moves)
                want = np.zeros((len(psi), k))
                for path in itertools.product(range(k), repeat=len(psi)):
                    p = np.prod([psi[i, y] for i, y in enumerate(path)]) * np.prod([trans[x, y] for x, y in zip(path, path[1:])])
                    want[np.arange(len(psi)), path] += p
                want /= want.sum(1, keepdims=True)
                assert np.allclose(m.label_words(w), want, atol=1e-9)
                mean = want.mean(0)
                assert m.predict([text]) == [(m.labels[mean.argmax()], pytest.approx(mean.max()))]
    finally:
        crf.BLOCK = old


def test_transitions_learn_to_switch():
    rng = random.Random(5)
    langs = list("ab" * 40)
    texts = [words_of(x, rng, 60) for x in langs]
    samples = crf.joined(texts, langs)
    assert len(samples) == 40 and all(len(s) >= 2 and all(x[1] != y[1] for x, y in zip(s, s[1:])) for s in samples)
    m = crf.train(texts, langs, 40)
    stay, switch = m.moves[0, 0] - m.moves[0, 1], sum(len(s) - 1 for s in samples)
    words = sum(len(t.split()) for t in texts) + sum(len(t.split()) for s in samples for t, _ in s)
    assert 0.3 * switch / words < 1 / (1 + np.exp(stay)) < 0.5  # switching stays possible, at about its share in the sample or above
    text = " ".join(words_of("ab"[i % 2], rng, 6) for i in range(8))
    assert len(m.runs(text)) >= 6  # short runs are told apart


def plain_tree(x, g, h, rows, depth, least):
    """The best tree by trying each statistic and each value between rows, without histograms: (statistic, cut, left, right) or the leaf's value."""
    best = (1e-9, None)
    if depth:
        for c in range(x.shape[1]):
            for cut in np.unique(x[rows, c])[:-1]:
                left = rows[x[rows, c] <= cut]
                if len(left) < least or len(rows) - len(left) < least:
                    continue
                (a, b), (s, t) = (g[left].sum(), h[left].sum()), (g[rows].sum(), h[rows].sum())
                gain = a**2 / (b + 1) + (s - a) ** 2 / (t - b + 1) - s**2 / (t + 1)
                if gain > best[0] * (1 + 1e-12):
                    best = (gain, (c, cut))
    if best[1] is None:
        return -quality.RATE * g[rows].sum() / (h[rows].sum() + 1)
    c, cut = best[1]
    on = x[rows, c] <= cut
    return c, cut, plain_tree(x, g, h, rows[on], depth - 1, least), plain_tree(x, g, h, rows[~on], depth - 1, least)


def walk(tree, row):
    while isinstance(tree, tuple):
        tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
    return tree


def test_trees_equal_plain_boosting():
    """Few values a statistic, so that quantile bins hold each value and the histogram search must find the exact splits."""
    rng = np.random.default_rng(12)
    x = rng.integers(0, 9, (300, 4)).astype(float)
    y = ((x[:, 0] + x[:, 1] > 9) ^ (rng.random(300) < 0.1)).astype(float)
    m = quality.grow(x, y, trees=4)
    score = np.full(300, m.base)
    for _ in range(4):
        p = 1 / (1 + np.exp(-score))
        tree = plain_tree(x, p - y, np.maximum(p * (1 - p), 1e-6), np.arange(300), quality.DEPTH, quality.LEAST_ROWS)
        score += [walk(tree, r) for r in x]
    assert np.allclose(m.raw(x), score, atol=1e-9)
    fresh = rng.integers(0, 9, (200, 4)).astype(float)

    def one(row):  # the flat arrays, one row and node at a time
        out = m.base
        for column, cut, value in zip(m.column, m.cut, m.value):
            at = 0
            while at < len(column):
                at = 2 * at + (1 if row[column[at]] <= cut[at] else 2)
            out += value[at - len(column)]
        return out

    assert np.allclose(m.raw(fresh), [one(r) for r in fresh])


def plain_secrets(text):
    """The base spans by the contract's words, scanned place by place."""
    keep = lambda c, more="": c.isascii() and c.isalnum() or c in more
    out, at = [], 0
    while at < len(text):  # assign
        word = next((w for w in ("password", "passwd", "secret", "token", "api_key", "apikey") if text[at : at + len(w)].isascii() and text[at : at + len(w)].lower() == w), None)
        end = None
        if word:
            tries = [at + len(word)] + ([at + len(word) + 1] if text[at + len(word) : at + len(word) + 1] in ("'", '"') else [])
            for i in reversed(tries):
                while text[i : i + 1] == " ":
                    i += 1
                if text[i : i + 1] not in (":", "="):
                    continue
                i += 1
                while text[i : i + 1] == " ":
                    i += 1
                for j in ([i + 1] if text[i : i + 1] in ("'", '"') else []) + [i]:
                    e = j
                    while e < len(text) and keep(text[e], "+/_.=-"):
                        e += 1
                    if e > j:
                        end = (j, e)
                        break
                if end:
                    break
        if end:
            if end[1] - end[0] >= 8:
                out.append((at, 0, end[1]))
            at = end[1]
        else:
            at += 1
    at = 0
    while (at := text.find("AKIA", at)) >= 0:
        e = at + 4
        while e < len(text) and ("A" <= text[e] <= "Z" or "0" <= text[e] <= "9"):
            e += 1
        if e == at + 4:
            at += 1
            continue
        if e - at >= 16:
            out.append((at, 1, e))
        at = e
    at = 0
    while at < len(text):
        e = at
        while e < len(text) and text[e] in "0123456789abcdef":
            e += 1
        if e - at >= 32:
            out.append((at, 2, e))
        at = max(e, at + 1)
    return sorted(out)


def test_base_spans_equal_a_plain_scan():
    rng = random.Random(15)
    bits = ["password", "PassWd", "secret", "token", "api_key", "APIKEY", "'", '"', " ", "  ", ":", "=", "AKIA", "ABCD1234", "Z", "0", "deadbeef", "0123456789abcdef" * 2, "x", "é", "ſ", "K", "\n", "\t", "-", ".", "/", "+", "_", "abcdefgh", "12345678", "AK", "IA"]
    for _ in range(20_000):
        text = "".join(rng.choice(bits) for _ in range(rng.randrange(14)))
        base, every = secrets.spans(text)
        assert base == plain_secrets(text), text
        assert [x for x in every if x[1] < 3] == base


def plain_shingles(text, n):
    import re

    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def test_shingles():
    texts = TEXTS + noise(9, 300, "ab \n É", 40) + [None, "a b c", "A b C", "a b", "a b c d", "a b c d a b c d"]
    h, n = shingles.shingle_sets(texts, 4)
    sets = [frozenset(s.tolist()) for s in np.split(h, np.cumsum(n)[:-1])]
    plain = [plain_shingles(t, 4) for t in texts]
    assert [len(s) for s in sets] == [len(p) for p in plain] == n.tolist()
    for i in range(0, len(texts), 7):
        for j in range(len(texts)):
            assert len(sets[i] & sets[j]) == len(plain[i] & plain[j])


def test_sketches_merge_and_estimate():
    rng = np.random.default_rng(10)
    pool = rng.integers(0, 1 << 63, 3000, np.uint64)
    a, b = pool[:2000], pool[500:3000]
    s = setsketch.sketches(np.concatenate([a, b, pool]), np.array([2000, 2500, 3000, 0]))
    assert (setsketch.merge(s[0], s[1]) == s[2]).all() and not s[3].any()
    j = setsketch.similarity(s[:1], s[1:2], np.array([2000]), np.array([2500]))
    assert abs(j[0] - 0.5) < 0.15
    assert setsketch.similarity(s[:1], s[:1], np.array([2000]), np.array([2000]))[0] > 0.99


def test_neighbours_against_brute_force():
    rng = np.random.default_rng(11)
    x = rng.normal(size=(3000, 20))
    x[100:200] = x[100]  # a hot vector
    ids = rng.permutation(3000)
    index = ann.fit(x[:1000], 20)
    q_ids, q = ids[:50], x[:50]
    q_ids, q = np.append(q_ids, ids[150]), np.concatenate([q, x[150:151]])
    order = np.argsort(q_ids)
    last = int(np.flatnonzero(order == 50)[0])
    q_ids, q = q_ids[order], q[order]
    twice, codes = np.tile(np.arange(3000), 2), ann.packed(ann.encode(x, index.books, index.weight))
    i, found, d = ann.scan(index, q_ids, q, ids[twice], x[twice], codes[twice], 10)
    hits = 0
    for k in range(len(q)):
        true = np.sqrt(((x - q[k]) ** 2).sum(1))
        order = [n for n in np.lexsort((ids, true)) if ids[n] != q_ids[k]][:10]
        mine = found[i == k].tolist()
        hits += len({int(ids[n]) for n in order} & set(mine))
        assert np.allclose(d[i == k], np.sort(d[i == k])) and q_ids[k] not in mine and len(set(mine)) == 10
    assert hits / (10 * len(q)) >= 0.9
    assert found[i == last].tolist() == sorted(set(ids[100:200].tolist()) - {int(ids[150])})[:10]


def test_anisotropic_codes_favour_the_parallel_part():
    rng = np.random.default_rng(12)
    x = rng.normal(size=(2000, 16))
    index = ann.fit(x, 16)

    def parallel(weight):
        codes = ann.encode(x, index.books, weight)
        r = (ann.pad(x) - index.books[np.arange(4), codes]).reshape(2000, -1)
        return (((r * x).sum(1) / np.linalg.norm(x, axis=1)) ** 2).mean()

    assert parallel(8.0) < parallel(0.0)
