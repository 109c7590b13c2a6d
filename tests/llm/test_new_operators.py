"""Vector codes, spelling variants and sum-of-squares packing against plain versions."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.llm import pretokens, queries, spelling, square_packing, token_count, vector_codes

tokenizers = pytest.importorskip("tokenizers")
SF = "/root/testdata/sf0.001"


# 11 vector codes


def codes(rows, parts=8, entries=16, rounds=6):
    """{row number: (id, code, error, label_error)} and the digest, by comparing every part with every entry. All vectors have one length."""
    kept = [(k, i, lab, [math.floor(4096 * x) for x in v]) for k, (i, v, lab) in enumerate(rows) if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = len(kept[0][3]) // parts if kept else 0
    split = {k: [v[p * width : (p + 1) * width] for p in range(parts)] for k, _, _, v in kept}
    first = sorted((x for x in kept if x[1] is not None), key=lambda x: x[1])[:entries]
    books = [[split[x[0]][p] for x in first] for p in range(parts)]

    def nearest(part, book):
        return min((sum((a - b) ** 2 for a, b in zip(part, e, strict=True)), n) for n, e in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            members = defaultdict(list)
            for k in split:
                members[nearest(split[k][p], books[p])[1]].append(split[k][p])
            for e, found in members.items():
                books[p][e] = [sum(c) // len(found) for c in zip(*found, strict=True)]
    out, sums = {}, defaultdict(int)
    for k, i, lab, _ in kept:
        found = [nearest(split[k][p], books[p]) for p in range(parts)]
        out[k] = (i, "".join(f"{n:02x}" for _, n in found), sum(d for d, _ in found), lab)
        sums[lab] += out[k][2]
    digest = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    return sorted(((i, c, d, sums[lab], digest) for i, c, d, lab in out.values()), key=repr)


def compressed(spark, rows, **options):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumns({"code": F.lit("x"), "_ints": F.lit(1)})
    return sorted((tuple(r) for r in vector_codes.compress(df, **options).collect()), key=repr)


def test_codes(spark):
    rng = random.Random(5)
    rows = [(k * 3 % 101, [rng.choice((-1, 0, 0.25, 1)) * rng.random() for _ in range(16)], rng.choice((None, 1, 2))) for k in range(101)]
    rows += [(k, [0.5, -0.25] * 8, None) for k in range(200, 290)]  # a hot vector
    rows += [(300, None, 1), (301, [None] + [0.0] * 15, 1), (302, [float("nan")] * 16, 1), (303, [float("inf")] * 16, 1), (None, rows[3][1], 2), (60, rows[4][1], 2)]
    assert compressed(spark, rows) == codes(rows)


def test_codes_of_ties_few_rows_and_large_values(spark):
    ties = [(k, [float(k % 4)] * 8, 1) for k in range(12)]  # equal entries: the lower index wins
    assert compressed(spark, ties) == codes(ties)
    large = [(k, [(-1) ** k * 2.0 ** (20 + k)] * 16, k % 2) for k in range(7)]  # squares beyond 64 bits, by Python's integers
    want = [(i, c, min(e, (1 << 63) - 1), min(t, (1 << 63) - 1), h) for i, c, e, t, h in codes(large)]
    assert compressed(spark, large) == want
    assert compressed(spark, []) == []


def test_codes_of_other_lengths(spark):
    rows = [(k, [k / 10] * 16, 0) for k in range(20)] + [(50, [1.0] * 8, 0), (51, [], 0)]
    want = codes(rows[:20])
    found = compressed(spark, rows)
    assert [r for r in found if r[0] < 50] == want
    assert [r[:3] for r in found if r[0] >= 50] == [(50, None, None), (51, None, None)] and all(r[3] == want[0][3] for r in found)
    assert compressed(spark, [(k, [], k % 2) for k in range(3)]) == [(k, "00" * 8, 0, 0, hashlib.sha256(b"").hexdigest()) for k in range(3)]
    odd = [(k, [k / 7, -k / 3, 1.0], None) for k in range(30)]  # filled up with zeros
    assert compressed(spark, odd) == codes([(i, v + [0.0] * 5, lab) for i, v, lab in odd])


def test_tree_finds_what_a_scan_finds():
    rng = np.random.default_rng(2)
    for trial in range(40):
        book, x = rng.integers(-3, 4, (rng.integers(1, 40), 3)), rng.integers(-4, 5, (200, 3))
        far = ((x[:, None, :] - book[None]) ** 2).sum(axis=2)
        at, best = vector_codes.CodeTree(book).nearest(x)
        assert (at == far.argmin(axis=1)).all() and (best == far.min(axis=1)).all()


# 12 spelling variants


def one_apart(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def variants(rows):
    import re

    low, counts = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(low)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            counts[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 31 == 0 else run] += 1
    n = {w: c for w, c in counts.items() if len(w) >= 7 and c >= 2}
    near = {w: [x for x in n if one_apart(w, x)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best and n[best] >= 10 * n[w] else None

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return sorted((w, form[w], root(w), n[w], len(near[w]), n.get(form[w])) for w in n)


def test_spelling(spark):
    rng = random.Random(8)
    stems = ["retrieval", "éléphant", "ÀÿÀÿÀÿÀ", "abababab", "aaaaaaaa", "mississippi", "straßenbahn"]
    rows = []
    for k in range(160):
        line = []
        for _ in range(60):
            w = list(rng.choice(stems))
            while rng.random() < 0.25:
                p = rng.randrange(len(w))
                w[p : p + 1] = rng.choice(([], [rng.choice("abé")], [w[p], rng.choice("abÿ")]))
            line.append("".join(w).title() if rng.random() < 0.2 else "".join(w))
        rows.append((rng.choice((k, 7, None)), rng.choice((" ", "-", "1")).join(line)))
    rows += [(900, None), (901, ""), (902, "x" * 5000 + " " + "x" * 5000), (903, "short ab"), (904, "retrieval " * 3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"word": F.lit("w"), "n": F.lit(1)})
    found = spelling.spelling_variants(df)
    assert found.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    want = variants(rows)
    assert sorted(tuple(r) for r in found.collect()) == want
    assert any(r[1] and r[1] != r[2] for r in want) and sum(r[4] for r in want) > 1000  # chains, and many links
    assert spelling.spelling_variants(df.where("false")).count() == 0


# 13 sum-of-squares packing


def squares(sizes, window):
    """Each size's (window, offset), with the sum of squares written out."""
    room, home = [], {}
    for k in sorted(range(len(sizes)), key=lambda k: (-sizes[k], k)):
        fits = [b for b in range(len(room)) if room[b] >= sizes[k]]
        counts = Counter(r for r in room if r)

        def after(b):
            changed = counts.copy()
            changed[room[b]] -= 1
            changed[room[b] - sizes[k]] += 1
            return sum(v * v for g, v in changed.items() if g), room[b] - sizes[k]

        if not fits:
            room.append(window)
        b = min(fits, key=after) if fits else len(room) - 1
        home[k] = after(b)[0] if fits else None, room[b]
        room[b] -= sizes[k]
    return room, home


def test_sum_of_squares():
    rng = random.Random(4)
    for window in (7, 20, 64):
        for _ in range(20):
            sizes = [rng.randint(1, window) for _ in range(rng.randint(0, 60))]
            home, offset = square_packing.sum_of_squares(np.array(sizes, np.int64), window)
            room, steps = squares(sizes, window)
            used = defaultdict(list)
            for k, (b, o) in enumerate(zip(home, offset, strict=True)):
                used[b].append((o, sizes[k]))
                assert window - o == steps[k][1]  # it went to a window of the same room
            for pieces in used.values():
                at = 0
                for o, size in sorted(pieces):
                    assert o == at
                    at += size
                assert at <= window
            assert len(used) == len(room)


ODD = [None, "", " \n\t", "a", "x" * 9000, "mot " * 6000, "é日本 ß y ΑΣ Σ", "<|endoftext|> a <| b", "Ɤ b", "å֊ c", "é ʼn", "ab́ " * 40000]


def test_packing_whole_documents(spark):
    path = queries.tokenizer("word_bpe_49k.json")
    library = tokenizers.Tokenizer.from_file(path)
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()] + [(1000 + k, t) for k, t in enumerate(ODD)] + [(None, "a b"), (1003, "a")] + [(5, "hot")] * 400
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"piece": F.lit("x"), "number": F.lit(1)})
    want = Counter()
    for i, t in rows:
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        for at in range(0, len(ids), 4096):
            want[i, at // 4096, at, len(ids[at : at + 4096]), zlib.crc32(ids[at : at + 4096].tobytes())] += 1
    for group, parts in ((square_packing.GROUP, 1), (100, 7)):
        found = square_packing.pack_whole(df.repartition(parts), path, group=group).collect()
        assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in found) == want
        sequences = defaultdict(list)
        for r in found:
            sequences[r.sequence_id].append((r.offset, r.length))
        for pieces in sequences.values():
            at = 0
            for offset, length in sorted(pieces):
                assert offset == at
                at += length
            assert at <= 4096
        least = -(-sum(r.length for r in found) // 4096)
        assert len(sequences) <= least + (3 if group > 100 else 20)
    assert square_packing.pack_whole(df.where("false"), path).count() == 0


def test_word_ids():
    path = queries.tokenizer("word_bpe_49k.json")
    library, own, rng = tokenizers.Tokenizer.from_file(path), square_packing.WordIds(path), random.Random(6)
    words = sorted({x.removesuffix("</w>") for x in library.get_vocab() if x.isascii() and "<" not in x})
    texts = ["".join(rng.choice(words) for _ in range(rng.randint(1, 5))) for _ in range(20_000)] + ["".join(rng.choice("etaoinßé'3-. 日") for _ in range(40)) for _ in range(4000)]
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert [x.tolist() for x in own.of(texts)] == want


def test_unsettled_texts_as_the_library_has_them():
    path = queries.tokenizer("word_bpe_49k.json")
    library = tokenizers.Tokenizer.from_file(path)
    assert token_count.Counter(path).counts([t or "" for t in ODD]).tolist() == [len(library.encode(t or "", add_special_tokens=False).ids) for t in ODD]
    assert ["".join(pretokens.by_spaces(t, 10)) for t in ODD if t] == [t for t in ODD if t]


@pytest.mark.parametrize("name", ["op13_square_packing"])
def test_registered_packing(spark, name):
    found = queries.queries()[name](spark, SF).collect()
    least = -(-sum(r.length for r in found) // 4096)
    assert len({r.sequence_id for r in found}) <= least + 1 and len({r.doc_id for r in found}) == spark.read.parquet(f"{SF}/documents.parquet").count()
