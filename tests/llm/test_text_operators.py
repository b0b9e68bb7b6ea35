import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest

from strandmill.llm import mixing, packing, pii, quality, simhash, token_counts, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score string, length int, rank int"
ODD = [None, "", " \t\n", "a", "word " * 3000, "x" * 50_000, "é漢 \U0001f600", "same text here again", "same text here again"]


def odd_docs(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows and columns with clashing names."""
    rows = [(i, t, None if i % 2 else "en", ["b", None, "a"][i % 3], None, "s", 1, 2) for i, t in enumerate(ODD)]
    rows += [rows[-1], (None, "no id", "en", "a", 3, None, None, None), (None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, DOCS)


def no_docs(spark):
    return spark.createDataFrame([], DOCS)


# token counts


def unigram_tokenizer(model_file):
    import sentencepiece
    from tokenizers import Tokenizer, models, normalizers

    sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
    vocab = [(f"\x00{i}" if sp.is_control(i) or sp.is_unknown(i) else sp.id_to_piece(i), sp.get_score(i)) for i in range(sp.get_piece_size())]
    t = Tokenizer(models.Unigram(vocab, unk_id=0, byte_fallback=True))
    t.normalizer = normalizers.Sequence([normalizers.Prepend("▁"), normalizers.Replace(" ", "▁")])
    return t


def test_token_counts_equal_a_public_unigram_tokenizer(spark, small):
    file = public_tokenizers.path("piece_bpe_32k.model")
    docs = spark.read.parquet(f"{small}/documents.parquet")
    found = {r.doc_id: r.n_tokens for r in token_counts.token_counts(docs, file).collect()}
    tokenizer = unigram_tokenizer(file)
    rows = docs.select("doc_id", "text").collect()
    assert found == {r.doc_id: len(tokenizer.encode(r.text, add_special_tokens=False).ids) for r in rows}


def test_viterbi_ties_and_unknowns():
    counter = token_counts.UnigramCounter({"a": -1, "b": -1, "ab": -2, "abc": -5, "c": -3, "▁": -1, "▁a": -2})
    assert counter.part("ab") == (-2, 1)  # one piece or two with one score: the longer piece comes first
    assert counter.part("abc") == (-5, 1)
    assert counter.part("é") == (-15, 2) and counter.part("aé") == (-16, 3)
    assert counter.count(None) == counter.count("") == (0, 0)
    rng = random.Random(0)
    pieces = {"▁": -2}
    for _ in range(40):
        pieces["".join(rng.choice("abc") for _ in range(rng.randrange(1, 5)))] = -rng.randrange(1, 9)
    counter = token_counts.UnigramCounter(pieces)
    for _ in range(300):
        s = "".join(rng.choice("abcd") for _ in range(rng.randrange(1, 12)))
        best = [(0, 0)] + [None] * len(s)
        for i in range(len(s)):
            single = False
            for j in range(i + 1, len(s) + 1):
                if (p := pieces.get(s[i:j])) is not None:
                    single |= j == i + 1
                    if best[j] is None or best[i][0] + p > best[j][0]:
                        best[j] = (best[i][0] + p, best[i][1] + 1)
            if not single and (best[i + 1] is None or best[i][0] + counter.unknown > best[i + 1][0]):
                best[i + 1] = (best[i][0] + counter.unknown, best[i][1] + 1)
        assert counter.part(s) == best[-1]


def test_token_counts_of_odd_rows(spark):
    file = public_tokenizers.path("piece_bpe_32k.model")
    assert token_counts.token_counts(odd_docs(spark), file).count() == len(ODD) + 3
    assert token_counts.token_counts(no_docs(spark), file).count() == 0


# SimHash


def brute_classes(fps, max_diff):
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(fps)):
        for j in np.flatnonzero(np.bitwise_count(fps[i + 1 :] ^ fps[i]).sum(1) <= max_diff) + i + 1:
            a, b = find(i), find(int(j))
            parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


@pytest.mark.parametrize("bits,max_diff,blocks,cell_rows", [(64, 4, 5, 4096), (64, 4, 5, 60), (64, 4, 6, 4096), (256, 3, 4, 60)])
def test_linked_fingerprints_equal_brute_force(spark, bits, max_diff, blocks, cell_rows):
    r = np.random.default_rng(blocks)
    rows = {bytes(bits // 8)}
    for _ in range(60):
        one = r.integers(0, 2, bits).astype(np.uint8)
        for _ in range(8):
            one[r.choice(bits, r.integers(0, 7), replace=False)] ^= 1
            rows.add(np.packbits(one).tobytes())
    rows = sorted(rows)
    fps = np.frombuffer(b"".join(rows), np.uint64).reshape(len(rows), -1)
    classes = spark.createDataFrame([(i, bytearray(x)) for i, x in enumerate(rows)], "class long, fp binary")
    found = simhash.components(simhash.links(classes, max_diff, simhash.block_routes(bits, max_diff, blocks), cell_rows)).collect()
    class_of = dict(enumerate(range(len(rows)))) | {row.node: row.component for row in found}
    expected = brute_classes(fps, max_diff)
    assert class_of == dict(enumerate(expected)) and len(set(expected)) < len(fps)


def test_gray_order_is_the_reflected_sequence():
    x = np.array([[i ^ i >> 1] for i in range(4096)], np.uint64)
    assert (simhash.gray_order(x)[0] == np.arange(4096)).all()
    wide = np.random.default_rng(0).integers(0, 1 << 63, (500, 3)).astype(np.uint64)

    def rank(words):  # the place of a codeword of 192 bits
        bits, place, odd = "".join(f"{int(w):064b}" for w in words), 0, 0
        for b in bits:
            odd ^= int(b)
            place = place * 2 + odd
        return place

    order = np.lexsort(simhash.gray_order(wide)[::-1])
    ranks = [rank(wide[i]) for i in order]
    assert ranks == sorted(ranks)


def test_long_fingerprints_find_similar_texts(spark):
    r = random.Random(7)
    rows, copies = [], {}
    for i in range(0, 400, 2):
        words = ["".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(r.randrange(120, 400))]
        near = list(words)
        for _ in range(max(1, len(words) // 100)):  # one word in a hundred, about 0.9
            near[r.randrange(len(near))] = "changed"
        other = [w if r.random() < 0.9 else "else" for w in words]  # far below 0.8
        rows += [(i, " ".join(words)), (i + 1, " ".join(near)), (10_000 + i, " ".join(other))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    share = simhash.share_of_bits(0.8)
    limit = simhash.expected_diff(share, 1024, deviations=0.7)
    out = simhash.near_duplicates(docs, 5, 1024, limit, True, lambda n: simhash.sampled_routes_for(n, 1024, share)).collect()
    found = {row.doc_id: row.component_id for row in out}
    assert sum(found[i + 1] == i for i in range(0, 400, 2)) >= 194
    assert all(found[i] == i for i in found if i >= 10_000 or i < 400 and i % 2 == 0)


def test_fingerprint_is_the_majority_of_shingle_hashes():
    import xxhash

    text = "The quick  brown\tfox jumps\nover THE lazy dog"
    words = text.lower().split()
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 4]).encode(), 42) for i in range(len(words) - 3)]
    expected = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    assert simhash.fingerprint(text) == expected.to_bytes(8, "big")
    assert simhash.fingerprint(None) == simhash.fingerprint(" \n") == bytes(8)
    assert simhash.fingerprint("One two") == xxhash.xxh64_digest(b"one two", 42)
    assert simhash.fingerprint("É a") == xxhash.xxh64_digest("É a".encode(), 42)  # A-Z only are lowered
    assert len(simhash.fingerprint(text, 5, 256)) == 32
    long = " ".join(str(i * i) for i in range(20_003))
    hashes = [xxhash.xxh64_intdigest(" ".join(long.split()[i : i + 4]).encode(), 42) for i in range(20_000)]
    assert int.from_bytes(simhash.fingerprint(long), "big") == sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > 20_000)
    assert simhash.fingerprint("a b c d e " * 9, 5, 512, distinct=True) == simhash.fingerprint("a b c d e " * 2 + "a b c d", 5, 512, distinct=True)


@pytest.mark.parametrize("n", [0, 1, 10**4, 10**7, 10**10])
def test_routes_keep_groups_small(n):
    blocks = simhash.block_routes_for(n, 64, 4)
    assert n >> min(map(len, blocks)) <= 2048 and len(blocks) >= 5
    sampled = simhash.sampled_routes_for(n, 512, simhash.share_of_bits(0.8))
    meet = (1 - simhash.share_of_bits(0.8)) ** len(sampled[0])
    assert n <= 512 << len(sampled[0]) and 1 - (1 - meet) ** len(sampled) >= 0.98


def test_near_duplicates_of_odd_rows(spark):
    rows = simhash.near_duplicates(odd_docs(spark)).collect()
    assert len(rows) == len(ODD) + 3
    by_id = {r.doc_id: r for r in rows if r.doc_id is not None}
    assert {by_id[i].component_id for i in (0, 1, 2)} == {0} and by_id[0].fingerprint == "0" * 16
    assert by_id[8].component_id == 7 and by_id[4].component_id == 4
    assert simhash.near_duplicates(no_docs(spark)).count() == 0


# quality


def test_ordinal_model_orders_graded_documents(spark):
    r = np.random.default_rng(0)
    good, bad = "alpha beta gamma delta".split(), "spam! $$$ win win win".split()
    rows, grades = [], []
    for i in range(400):
        g = i % 4
        words = [str(r.choice(good if r.random() < g / 3 else bad)) for _ in range(60)]
        rows.append((i, " ".join(words)))
        grades.append((i, g))
    docs, rated = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(grades, "doc_id long, g int")
    model = quality.fit(docs.where("doc_id < 300"), rated, "g")
    assert model.grades == [0, 1, 2, 3] and (np.diff(model.thresholds) > 0).all()
    out = quality.grade(docs.where("doc_id >= 300"), model, at_least=2).toPandas().sort_values("doc_id")
    truth = np.array([g for i, g in grades if i >= 300])
    assert np.abs(out.expected_grade - truth).mean() < 0.5
    assert ((out.tail_probability >= 0.5) == (truth >= 2)).mean() > 0.9


def test_ordinal_gradient():
    r = np.random.default_rng(1)
    rows, places, values, grade = np.repeat(np.arange(30), 3), r.integers(0, 8, 90), r.random(90), r.integers(0, 3, 30).astype(float)
    fit = quality.fit_ordinal(rows, places, values, grade, 8, steps=800, ridge=1e-2)

    def loss(w, t):
        s = np.bincount(rows, values * w[places], 30)
        b = np.r_[-50, t, 50]
        y = grade.astype(int)
        p = 1 / (1 + np.exp(-(b[y + 1] - s))) - 1 / (1 + np.exp(-(b[y] - s)))
        return -np.log(p).mean() + 0.5e-2 * (w**2).sum()

    at = loss(fit.weights, fit.thresholds)
    for k in range(8):
        e = np.eye(8)[k] * 0.05
        assert loss(fit.weights + e, fit.thresholds) > at - 1e-4
    assert loss(fit.weights, fit.thresholds + np.array([0.05, 0.05])) > at - 1e-4


def test_quality_scores_equal_direct_ones(spark, monkeypatch):
    monkeypatch.setattr(quality, "REMEMBER", 4)
    r = np.random.default_rng(6)
    model = quality.Ordinal([1.0, 2.0, 4.0], np.array([-0.5, 0.75]), r.normal(0, 1, 64))
    words = ["Ab", "ab", "x1", "12", "...", "É" * 50, "win", "win"]
    texts = [" ".join(r.choice(words, n)) for n in (1, 2, 9, 300)] + ["win win win", "", None, " \t\n"]

    def direct(text):
        tokens, total = (text or "").split(), 0.0
        for i, t in enumerate(tokens):
            total += sum(model.weights[p] for p in quality.token_features(t, 64)) + model.weights[0] * (i > 0 and tokens[i - 1] == t)
        return total * quality.SCALE / len(tokens) if tokens else 0.0

    expected = np.array([direct(t) for t in texts])
    known = {}
    for _ in range(2):
        assert np.allclose(quality.scores(texts, model, known), expected) and len(known) <= 4
    p = 1 / (1 + np.exp(expected[:, None] - model.thresholds))
    found = quality.grade(spark.createDataFrame([*enumerate(texts)], "doc_id long, text string"), model).toPandas().sort_values("doc_id")
    assert np.allclose(found.tail_probability, 1 - p[:, 1]) and np.allclose(found.expected_grade, p[:, 0] + 2 * (p[:, 1] - p[:, 0]) + 4 * (1 - p[:, 1]))
    assert (found.kept == (found.tail_probability >= 0.5)).all()


def test_quality_on_the_tables_and_odd_rows(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    held = labels.where("doc_id % 3 = 0")
    model = quality.fit(docs, labels.where("doc_id % 3 <> 0"), "quality")
    found = quality.grade(docs, model).join(held, "doc_id").toPandas()
    assert (found.kept == (found.quality == 1)).mean() > 0.97
    assert found.kept[found.quality == 1].mean() > 0.99
    assert quality.grade(odd_docs(spark), model).count() == len(ODD) + 3
    assert quality.keep(odd_docs(spark), model).columns == odd_docs(spark).columns
    assert quality.fit(no_docs(spark), labels, "quality") is None
    assert quality.grade(odd_docs(spark), None).where("kept").count() == len(ODD) + 3
    assert quality.grade(no_docs(spark), model).count() == 0


# personal data

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain_base(text):
    out = []
    for kind, p in PATTERNS.items():
        for m in re.finditer(p, text):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else 0, "card": 14 <= len(d) <= 19 and pii.luhn(d) if kind == "card" else 0, "phone": 10 <= len(d) <= 15}[kind]
            if ok:
                out.append((m.start(), m.end(), kind))
    return sorted(out, key=lambda s: (s[0], pii.KINDS.index(s[2])))


def test_base_spans_equal_the_patterns(spark, small):
    r = random.Random(3)
    texts = ["".join(r.choice("a1.2@-+ 5()3%é9") for _ in range(r.randrange(60))) for _ in range(5000)]
    texts += [row.text for row in spark.read.parquet(f"{small}/documents.parquet").select("text").collect()]
    texts += ["4111 1111-1111 1111 and 4111111111111112", "a@b.c@d.e", "1.2.3.4.5.6.7.8 300.1.1.1 001.2.3.4"]
    assert [pii.base_spans(t) for t in texts] == [plain_base(t) for t in texts]


def test_long_texts_take_linear_time():
    import time

    begun = time.time()
    for t in ("a" * 300_000, "1" * 300_000, "1." * 150_000, "a@" * 100_000, "+1 " * 100_000, "1 " * 150_000, ":" * 200_000, "(12) " * 60_000):
        pii.all_spans(t, *pii.model())
    assert time.time() - begun < 60


def test_trees_accept_personal_and_leave_other_items():
    trees, limit = pii.model()
    hit = n = wrong = clean = 0
    for text, real in pii.examples(1500, seed=99):
        found = pii.all_spans(text, trees, limit)
        if real:
            n += 1
            hit += any(a < real[1] and real[0] < b for a, b, _ in found)
        else:
            clean += 1
            wrong += bool(found)
    assert hit / n > 0.9 and wrong / clean < 0.05


def test_spelled_templates_are_candidates():
    for at, dot in [("(at)", "(dot)"), ("[at]", "[dot]"), (" at ", " dot "), (" [at] ", " [dot] "), ("{at}", "."), (" @ ", "."), (" at ", ".")]:
        for case in (str, str.title, str.upper):
            item = f"john{case(at)}example{case(dot)}com"
            assert (6, 6 + len(item), "email") in pii.candidates(f"write {item}"), item


def test_redaction_and_rows(spark):
    text = "write jo@ex.org, call +1 (503) 555-0199!"
    assert pii.redacted(text, pii.base_spans(text)) == "write [EMAIL], call [PHONE]!"
    assert pii.redacted("abcdef", [(1, 4, "ip"), (2, 5, "card")]) == "a[IP]f"
    odd = odd_docs(spark)
    assert pii.find(odd).count() == len(ODD) + 3 and pii.find(no_docs(spark)).count() == 0
    out = pii.redact(odd)
    assert out.columns == odd.columns and out.where("text is null").count() == odd.where("text is null").count()
    row = pii.find(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert row.base_sha256 == hashlib.sha256(b"email:6:15,phone:22:39").hexdigest()
    assert row.spans == "email:6:15,phone:22:39" and (row.n_email, row.n_ip, row.n_card, row.n_phone) == (1, 0, 0, 1)


# packing


def test_ids_equal_the_tokenizer(spark, small):
    file = public_tokenizers.path("word_bpe_49k.json")
    e = packing.RunEncoder(file)
    r = random.Random(1)
    texts = [row.text for row in spark.read.parquet(f"{small}/documents.parquet").select("text").collect()]
    texts += ["<|endoftext|> A<|startoftext|>b <|ENDOFTEXT|>", "I'll don't  ' s 'S", "àéíß Straße àÀß x÷y ÿ ć", "a.'s b'. c). é. «é». x….", "\x1c\x85 a\x0bb\x00"]
    texts += ["".join(r.choice("ab é\n\t ́漢'sS12Σς.,!İ<|> \x85") for _ in range(r.randrange(30))) for _ in range(3000)]
    for t, found in zip(texts, e.tokenizer.encode_batch(texts, add_special_tokens=False)):
        assert e.ids(t) == np.array(found.ids, "<u4").tobytes(), t


def test_patterns_hold_the_histogram():
    r = random.Random(2)
    for _ in range(200):
        histogram = {r.randrange(1, 64): r.randrange(1, 300) for _ in range(r.randrange(30))}
        patterns = packing.shortest_pack_first(histogram, 64)
        held = {}
        for n, parts in patterns:
            assert sum(length * c for length, c in parts) <= 64
            for length, c in parts:
                held[length] = held.get(length, 0) + n * c
        assert held == histogram
        assert len(patterns) <= 2 * 64
        total, packs = sum(k * v for k, v in histogram.items()), sum(n for n, _ in patterns)
        assert packs <= -(-total // 32) + 1  # no two packs are less than half full
    big = packing.shortest_pack_first({k: 10**9 + k for k in range(1, 2048)}, 2048)
    assert len(big) <= 2 * 2048


def check_packed(rows, seq_len):
    by_seq = {}
    for r in rows:
        by_seq.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by_seq.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= seq_len
    assert sorted(by_seq) == list(range(len(by_seq)))
    return len(by_seq)


def test_packing(spark, small):
    file = public_tokenizers.path("word_bpe_49k.json")
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = packing.pack(docs, file).collect()
    n = check_packed(rows, 2048)
    encoder = packing.RunEncoder(file)
    ids = {r.doc_id: encoder.ids(r.text) + (1).to_bytes(4, "little") for r in docs.collect()}
    for r in rows:
        piece = ids[r.doc_id][4 * r.start : 4 * (r.start + r.length)]
        assert zlib.crc32(piece) == r.ids_crc32 and len(ids[r.doc_id]) == 4 * r.doc_tokens
    assert sum(r.length for r in rows) == sum(len(x) // 4 for x in ids.values()) > 0.97 * 2048 * n
    odd = packing.pack(odd_docs(spark), file, seq_len=16).collect()
    check_packed(odd, 16)
    assert sum(r.length for r in odd if r.doc_id in (0, 1)) == 2
    assert packing.pack(no_docs(spark), file).count() == 0


# mixing


def water_level(sizes, weights, share, most):
    target, capped, total = [0.0] * len(sizes), [False] * len(sizes), share * sum(sizes)
    while True:
        free = sum(w for w, c in zip(weights, capped) if not c)
        rest = total - sum(most * s for s, c in zip(sizes, capped) if c)
        target = [most * s if c else rest * w / free for s, w, c in zip(sizes, weights, capped)]
        over = [not c and t > most * s for s, t, c in zip(sizes, target, capped)]
        if not any(over):
            return target
        capped = [a or b for a, b in zip(capped, over)]


def test_mix(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    found = mixing.mix(docs).toPandas()
    words = {r.doc_id: (r.source, len(re.findall(r"[^\x20\x09-\x0D]+", r.text))) for r in docs.collect()}
    assert len(found) == len(words) and all(words[i][1] == s for i, s in zip(found.doc_id, found["size"]))
    found["source"] = [words[i][0] for i in found.doc_id]
    names = sorted(set(found.source))
    total = found.groupby("source")["size"].sum()
    expected = water_level([int(total[n]) for n in names], [(5, 2, 1)[i % 3] for i in range(len(names))], 1.5, 2.0)
    for n, t in zip(names, expected):
        own = found[found.source == n]
        assert own.source_size.eq(total[n]).all() and np.allclose(own.target, t)
        base, rest = divmod(round(t), int(total[n]))
        sums = {0}
        for size in own["size"]:
            sums |= {x + size for x in sums if x + size <= rest}
        # few documents: the share of each length is rounded to none, so the subset is the best there is
        assert own.taken.sum() == base * total[n] + max(sums)
    assert (found.taken <= 2 * found["size"]).all() and (found.taken % found["size"].clip(1) == 0).all()
    again = mixing.mix(docs.repartition(7)).toPandas()
    assert again.sort_values("doc_id").taken.tolist() == found.sort_values("doc_id").taken.tolist()


def test_targets_of_many_sources(spark):
    r = np.random.default_rng(7)
    names = [f"host{i:03d}" for i in range(150)] + [None]
    sizes = [int(x) for x in r.integers(0, 5000, 151) ** 2 % 90_001 * r.integers(0, 2, 151)]
    totals = spark.createDataFrame(list(zip(names, sizes))[::-1], "source string, source_size long").repartition(5)
    found = {x.source: x.target for x in mixing.targets(totals, (5, 2, 1), 1.5, 2.0).collect()}
    expected = water_level(sizes, [(5, 2, 1)[i % 3] for i in range(151)], 1.5, 2.0)
    assert len(found) == 151 and np.allclose([found[n] for n in names], expected)
    assert np.isclose(sum(found.values()), 1.5 * sum(sizes)) and any(found[n] < 2 * s for n, s in zip(names, sizes))


def test_subset_sum_is_the_best():
    r = random.Random(0)
    for _ in range(200):
        sizes = r.sample(range(1, 30), r.randrange(1, 5))
        counts = [r.randrange(0, 4) for _ in sizes]
        budget = r.randrange(0, 60)
        sums = {0}
        for s, n in zip(sizes, counts):
            sums = {x + s * k for x in sums for k in range(n + 1)}
        take = mixing.subset_sum(np.array(sizes), np.array(counts), budget)
        assert (take <= counts).all() and int(take @ np.array(sizes)) == max(x for x in sums if x <= budget)


def test_mix_of_odd_rows(spark):
    odd = mixing.mix(odd_docs(spark)).toPandas()
    assert len(odd) == len(ODD) + 3 and (odd.taken[odd["size"] == 0] == 0).all() and (odd.taken <= 2 * odd["size"]).all()
    assert mixing.mix(no_docs(spark)).count() == 0
    only_empty = spark.createDataFrame([(1, "", "a"), (2, None, None)], "doc_id long, text string, source string")
    assert [(r.size, r.target, r.taken) for r in mixing.mix(only_empty).select("size", "target", "taken").collect()] == [(0, 0.0, 0)] * 2


# toxicity


def test_network_gradients():
    net = toxicity.Network(3)
    net.p = {k: v.astype("f8") for k, v in net.p.items()}
    inputs = toxicity.Inputs(["abc", "de", "idiot", "x", "é"])
    inputs.word, inputs.start = np.r_[inputs.word, 0], np.r_[inputs.start, inputs.start[-1]]
    r = np.random.default_rng(0)
    tok, mask = r.integers(0, 5, (4, 6)), np.ones((4, 6), bool)
    mask[1, 4:], tok[1, 4:] = False, 5
    odds, y, fold = r.standard_normal((2, 6, 3)), np.array([0, 1, 1, 0.0]), np.array([0, 1, 0, 1])
    run = lambda: net.gradients(inputs, odds, fold, tok, mask, y, np.ones(4), None)
    g = run()[1]
    g = {k: v if not isinstance(v, tuple) else v for k, v in g.items()}
    for k in ("in", "bias", "back", "ahead", "look", "out", "base", "word", "gram"):
        place = (g[k][0][1], 2) if isinstance(g[k], tuple) else tuple(r.integers(0, s) for s in net.p[k].shape)
        expected = g[k][1][g[k][0] == place[0], 2].sum() if isinstance(g[k], tuple) else g[k][place]
        was, losses = net.p[k][place], []
        for step in (0.01, -0.01):
            net.p[k][place] = was + step
            losses.append(run()[0])
        net.p[k][place] = was
        assert (losses[0] - losses[1]) / 0.02 == pytest.approx(expected, abs=2e-5, rel=0.02)


def test_windows_cover_the_text():
    for n in range(200):
        w = toxicity.windows(n)
        assert set(range(n)) <= {i for s in w for i in range(s, s + toxicity.WIDTH)}
        assert all(s + toxicity.WIDTH <= max(n, toxicity.WIDTH) for s in w)


def test_toxic_scores_equal_those_of_single_windows(monkeypatch):
    r = np.random.default_rng(2)
    net = toxicity.Network(5)
    net.p = {k: (v + r.normal(0, 0.2, np.shape(v))).astype("f4") for k, v in net.p.items()}
    net.calibration = np.array([-0.2, 0.9, 0.4, 0.1])
    names = [f"w{i}é"[: 1 + i % 4] + str(i) for i in range(60)]
    texts = [" ".join(r.choice(names, n)) for n in (1, 5, 24, 25, 36, 37, 200)] + ["", None, "!!! ..."]

    def direct(text):
        tokens, logits = toxicity.tokens_of(text), []
        if not tokens:
            return 0.0
        for s in toxicity.windows(max(len(tokens), toxicity.WIDTH)):
            part = tokens[s : s + toxicity.WIDTH]
            gates = np.concatenate([net.project(toxicity.Inputs([t]), np.zeros(1, np.int64)) for t in part])
            logits.append(net.forward(gates[:, None], np.ones((len(part), 1), bool))[0])
        return 1 / (1 + np.exp(-toxicity.summary(np.array(logits)) @ net.calibration))

    expected = np.array([direct(t) for t in texts])
    assert len(set(expected.round(4))) > 6
    for most, step in ((150_000, 10), (70, 1), (20, 3), (3, 10)):  # all kept, tables that fill up, batches that are larger
        monkeypatch.setattr(toxicity, "REMEMBER", most)
        scorer = toxicity.Scorer(net)
        for _ in range(2):
            found = np.concatenate([scorer.scores(texts[a : a + step]) for a in range(0, len(texts), step)])
            assert np.allclose(found, expected, atol=1e-4)


def test_an_insult_is_found_wherever_it_stands(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit(docs, labels, "toxic")
    clean = "Is and retitioning ouen the of nterti thorreou ndernt Is ndble whst the by for".split() * 20
    insult = "thou art reble stupid idiot anth worthless the moron erean of loser".split() * 2
    texts = [" ".join(clean[:at] + insult[:24] + clean[at:]) for at in range(0, 60)]
    s = toxicity.Scorer(model).scores([" ".join(clean), *texts])
    assert s[0] < 0.5 and (s[1:] >= 0.5).all()


def test_toxicity_on_the_tables(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    from pyspark.sql import functions as F

    known = labels.where(~toxicity.held_out(F.col("doc_id")))
    assert {r.doc_id for r in known.collect()} == {r.doc_id for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 5}
    model = toxicity.fit(docs, known, "toxic")
    found = toxicity.score(docs, model).toPandas()
    assert len(found) == docs.count() and found.score.between(0, 1).all() and (found.predicted == (found.score >= 0.5)).all()
    held = found[found.held_out].merge(labels.toPandas(), on="doc_id")
    assert (held.predicted == held.toxic).mean() > 0.85
    insult = "thou art reble stupid idiot anth worthless the moron erean of loser. " * 2
    clean = "Is and retitioning ouen the of, nterti thorreou ndernt. Is ndble whst the by for. " * 2
    s = toxicity.Scorer(model).scores([insult, clean, "", None, insult * 400])
    assert s[0] > 0.5 > s[1] and s[2] == s[3] == 0 and s[4] > 0.5
    assert toxicity.score(odd_docs(spark), model).count() == len(ODD) + 3
    assert toxicity.score(no_docs(spark), model).count() == 0
    assert toxicity.fit(docs, labels.where("toxic = 0"), "toxic") == 0.0 and toxicity.fit(docs, labels.where("false"), "toxic") == 0.5
    assert toxicity.score(odd_docs(spark), 0.5).count() == len(ODD) + 3


def test_fitting_takes_one_row_of_an_id(spark, monkeypatch):
    docs = spark.createDataFrame([(1, f"text {k}") for k in range(50)] + [(2, "good"), (3, "bad")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0, 0)] * 20 + [(2, 1, 1), (3, 0, 0)], "doc_id long, quality int, toxic int")
    seen = []
    monkeypatch.setattr(quality, "fit_ordinal", lambda rows, places, values, grade, dims: seen.append(len(grade)))
    monkeypatch.setattr(toxicity, "train", lambda texts, y, seed: seen.append(len(texts)))
    quality.fit(docs, labels, "quality")
    toxicity.fit(docs, labels, "toxic")
    long = docs.selectExpr("doc_id", "if(doc_id = 1, repeat(text, 100), text) as text")
    for longest in (599, 700):
        quality.fit(long, labels, "quality", longest=longest)
        toxicity.fit(long, labels, "toxic", longest=longest)
    assert seen == [3, 3, 2, 2, 3, 3]
