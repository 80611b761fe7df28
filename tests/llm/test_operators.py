"""Each operator against a brute-force version on a fixture with nulls, empty
and very long texts, ties, repeated rows, and extra columns of clashing names."""

import base64
import hashlib
import io
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lectern.llm import bpe, chat, crf, decontam, lm, neardup, quality, tokenfile, urlfilter, warc

RANKS, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
SPACE = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def corpus():
    rng = random.Random(5)
    words = ["the", "of", "and", "Über", "naïve", "x1", "it's", "end.", "a,b", "Été", "ΑΣ", "日本", "<|endoftext|>", "#tag", "!!"]
    text = lambda n: " ".join(rng.choice(words) + rng.choice(["", "s", "ed", str(rng.randrange(50))]) for _ in range(n))
    base = text(60)
    near = base.split(" ")
    near[30] = "changed"
    rows = [(1, base), (2, base.upper().replace("Ü", "Ü")), (3, " ".join(near)), (4, None), (5, ""), (6, "one two"), (7, "one two"), (8, text(6000)), (9, "a\n\nb  c\t d \n" + text(15)), (9, "a\n\nb  c\t d \n" + text(15)), (10, base), (10, base), (11, "x\x1cy \x85 z"), (None, text(20)), (12, " lead and trail  "), (13, "w " * 40)]
    rows += [(20 + k, text(rng.randrange(5, 80))) for k in range(25)]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    # extra columns whose names operators use themselves
    frame = spark.createDataFrame(corpus(), "doc_id long, text string").repartition(3)
    return frame.withColumns({"id": F.lit("x"), "n": F.lit(1), "class": F.lit("c"), "host": F.lit(None).cast("string"), "source": F.concat(F.lit("s"), F.col("doc_id") % 3), "n_chars": F.length("text").cast("long"), "ids": F.lit(0), "part": F.lit("p")})


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("1 = 0")


def test_bpe_equals_library_and_round_trips(docs, empty):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    library = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    found = bpe.round_trip_digests(docs, RANKS, PATTERN)
    inside = lambda t, ids: sum((b"".join(library.decode_tokens_bytes(ids))[at] & 0xC0) == 0x80 for at in np.cumsum([0, *map(len, library.decode_tokens_bytes(ids))])[:-1])
    rows = found.join(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("t"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("decoded_sha256")).distinct(), ["doc_id", "decoded_sha256"]).collect()
    assert all(r.n_split == inside(r.t, library.encode_ordinary(r.t)) for r in rows) and sum(r.n_split for r in rows) > 0
    got = sorted(map(tuple, found.drop("n_split").collect()), key=str)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = []
    for i, t in corpus():
        ids = library.encode_ordinary(t or "")
        want.append((i, len(ids), sha(" ".join(map(str, ids)).encode()), sha((t or "").encode())))
    assert got == sorted(want, key=str)
    assert bpe.round_trip_digests(empty, RANKS, PATTERN).count() == 0
    encoded = bpe.encode(docs, RANKS, PATTERN, with_offsets=True)
    for row in encoded.collect():
        raw = (row.text or "").encode()
        assert row.byte_starts[-1] == len(raw) and row.char_starts[-1] == len(row.text or "")
        assert len(row.byte_starts) == len(row.ids) + 1
    back = {r.id: bytes(r.decoded) for r in bpe.decode(encoded.where("id = 8"), RANKS, PATTERN).collect()}
    assert back[8].decode() == dict(corpus())[8]


def test_bpe_of_odd_texts():
    """Whole batches against the library: spaces in runs and at the ends, control characters, unbroken strings."""
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    library = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(9)
    texts = ["", " ", "  ", "a", " a", "a ", "a  b", "a\n b", "\n\na b\n", "x\x1c y", "日本 語 " * 9, "it's 42nd!!", "!" * 400, "e\u0301 x", "\u3000 x\u00a0y", "a\t\tb c", "😀 👩‍👩‍👧 z", "z" * 900]
    texts += ["".join(rng.choice(["a", " ", "  ", "\n", "é", "Z9", "!", "\x1f", "日", "'s", "\u00a0", "\r\n"]) for _ in range(rng.randrange(30))) for _ in range(600)]
    b = bpe.load(RANKS, PATTERN)
    for _ in range(2):
        flat, sizes = b.encode_batch(texts)
        assert [x.tolist() for x in np.split(flat, np.cumsum(sizes)[:-1])] == [library.encode_ordinary(t) for t in texts]
    assert [len(x) for x in b.encode_batch([])] == [0, 0]


def test_bpe_stream_joins_split_characters():
    b = bpe.load(RANKS, PATTERN)
    text = "日本語 ñ 😀"
    assert "".join(b.decode_stream(b.encode(text))) == text


@pytest.mark.parametrize("seed", range(6))
def test_simple8b_round_trip(seed):
    rng = np.random.default_rng(seed)
    n = int(rng.integers(0, 1500))
    ids = rng.integers(0, 1 << 63, n).astype(np.uint64) >> rng.integers(0, 63, n).astype(np.uint64)
    words, offsets, escapes = tokenfile.pack(ids)
    assert (tokenfile.unpack(words, offsets, escapes, n) == ids).all()


def test_token_file(docs, empty):
    library = Tokenizer.from_file(WORD_BPE)
    got = tokenfile.read_documents(tokenfile.write(docs, WORD_BPE, 2)).orderBy("start").collect()
    rows, start = sorted(corpus(), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")), 0
    for r, (i, t) in zip(got, rows, strict=True):
        ids = library.encode(t or "", add_special_tokens=False).ids + [2]
        assert (r.id, r.start, r.n_tokens, r.ids_crc32) == (i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert tokenfile.read_documents(tokenfile.write(empty, WORD_BPE, 2)).count() == 0


def test_token_file_of_odd_texts_and_ids(spark):
    """Control characters, marks of special tokens, unbroken strings; what is remembered stays short."""
    library = Tokenizer.from_file(WORD_BPE)
    texts = ["a\x1cb \x1d c", "<|ENDOFTEXT|> x<|endoftext|>Y", "ΑΣ σας", "e\u0301 \u0301x", "x\u3000y\u00a0z", "it's 42nd", "!" * 500, "語" * 3000, "Don'T", "a" * 900] + [f"w{k}\x1cv{k} " * 200 for k in range(40)]
    encoder = tokenfile.WordEncoder(WORD_BPE)
    for _ in range(2):
        ids, sizes = encoder.encode(texts)
        assert [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])] == [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert max(map(len, encoder._at)) <= tokenfile.CACHE_CHARS
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for kind in ("smallint", "decimal(20,2)", "string"):
        got = tokenfile.read_documents(tokenfile.write(frame.select(F.col("doc_id").cast(kind), "text"), WORD_BPE, 2))
        assert got.schema["id"].dataType.simpleString() == kind and got.count() == len(texts)


URLS = ["http://A.Example.com/en/x?q", "https://www.example.com/en/", "ftp://net/es/", "http://a.net/fr/1#f", "http://com", "no scheme", None, "", "http://x.org/en/", "http://example.com/english", "http://a.net/fr/1#f", "://com/", "http://xcom/"]
RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"), ("block", "example.com", "/engl"), ("block", "", "/")]


def judged(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = lower(re.match(r"[^/?#]*", rest)[0])
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    fit = [(len(h + p), h + p, v) for v, h, p in RULES if h and (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fit, default=(0, None, "allow"))
    return host, path, best[1], best[2]


@pytest.mark.parametrize("limit", [50_000, 0])
def test_url_rules(spark, limit):
    pages = spark.createDataFrame(list(enumerate(URLS)) + [(0, URLS[0])], "page_id long, url string").withColumn("rule", F.lit("r"))
    rules = spark.createDataFrame(RULES, "verdict string, host string, path string")
    got = urlfilter.judge(pages, rules, broadcast_rules=limit).select("page_id", "host", "path", "rule", "verdict").collect()
    want = [(i, *judged(u)) for i, u in list(enumerate(URLS)) + [(0, URLS[0])]]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert urlfilter.judge(pages.where("1 = 0"), rules).count() == 0
    assert {r.verdict for r in urlfilter.judge(pages, rules.where("1 = 0")).collect()} == {"allow"}


def test_chat_trees(spark):
    rows = [
        (1, 1, None, "user", "q <|im_end|>", 0.0), (1, 2, 1, "assistant", "bad", 0.1), (1, 3, 1, "assistant", r"good <\|im", 0.9), (1, 4, 3, "user", None, 0.0), (1, 5, 2, "user", "more", 0.2),
        (2, 1, 99, "sys\ntem\\n", "orphan", 0.0), (None, 1, None, "assistant", "null conversation", 0.0), (3, 1, 2, "user", "cycle", 0.0), (3, 2, 1, "user", "cycle", 0.0),
    ]
    messages = spark.createDataFrame(rows, "conv long, node long, parent long, role string, text string, score double").withColumn("formatted", F.lit(1))
    out = chat.format_trees(messages)
    got = {r.conv: r for r in out.select("conv", chat.parse(F.col("formatted")).alias("turns"), chat.learned_text(F.col("formatted"), F.col("loss_spans")).alias("learned")).collect()}
    assert [(t.role, t.text) for t in got[1].turns] == [("user", "q <|im_end|>"), ("assistant", r"good <\|im"), ("user", "")]
    assert got[1].learned == r"good <\|im"
    assert [(t.role, t.text) for t in got[2].turns] == [("sys\ntem\\n", "orphan")]
    assert got[None].learned == "null conversation" and 3 not in got
    assert chat.format_trees(messages.where("1 = 0")).count() == 0


def test_chat_chains_of_many_turns(spark):
    rows = [(7, k // 2, "assistant" if k % 2 else "user", f"t{k}") for k in range(70)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = chat.format_trees(chat.chains(turns, "conv_id", "turn", "role", "text")).select(chat.parse(F.col("formatted")).alias("turns")).first()
    assert [(t.role, t.text) for t in got.turns] == [(r[2], r[3]) for r in sorted(rows, key=lambda r: (r[1], r[2], r[3]))]


def measured(text):
    w = SPACE.findall(text or "")
    grams = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    hit = {i + k for i in range(len(w) - 4) if grams[tuple(w[i : i + 5])] > 1 for k in range(5)}
    lines = [x for x in (text or "").split("\n") if SPACE.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(hit)


def test_quality(docs, empty, spark):
    got = quality.judge(docs).drop("kept").collect()
    want = []
    for i, t in corpus():
        m = measured(t)
        want.append((i, *m, m[0] < 10 or 100 * m[4] > 20 * m[0]))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert quality.judge(empty).count() == 0 and quality.keep(empty).count() == 0
    hosts = spark.createDataFrame([(k, "few" if k % 2 else "good words enough to pass the rule of ten words here", "bad" if k % 2 or k < 8 else "fine") for k in range(200)], "doc_id long, text string, source string")
    kept = {r.doc_id for r in quality.keep(hosts).collect()}
    assert kept == set(range(8, 200, 2))  # also the passing documents of the failing host go
    assert quality.keep(hosts).columns == hosts.columns


def test_decontamination(docs, empty, spark):
    long = dict(corpus())[8].split(" ")
    items = [(1, " ".join(long[100:130])), (2, "one two"), (3, " ".join(long[110:118])), (4, None), (5, ""), (2, "one two")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t or ""))
    want = []
    for i, t in corpus():
        w, hit, found = words(t), set(), set()
        for k, it in items:
            x = words(it)
            m = min(13, len(x))
            for a in range(len(x) - m + 1) if x else ():
                for b in range(len(w) - m + 1):
                    if w[b : b + m] == x[a : a + m]:
                        hit |= set(range(b, b + m))
                        found.add(str(k))
        want.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    for size in (20_000_000, 60):  # one block of items, and several
        got = decontam.judge(docs, bench, max_chars=size).collect()
        assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert decontam.judge(empty, bench).count() == 0
    assert decontam.judge(docs, bench.where("1 = 0")).agg(F.sum("n_hit")).first()[0] == 0
    cleaned = decontam.clean(docs, bench)
    assert cleaned.columns == docs.columns
    assert decontam.judge(cleaned, bench).agg(F.sum("n_hit")).first()[0] == 0
    assert {r.doc_id for r in cleaned.collect()} == {i for i, _, _, _, _, bad in want if not bad}


def test_decontamination_in_blocks_of_items(spark):
    """The share and the cuts are those of all items, however many blocks they make."""
    rng = random.Random(4)
    passage = lambda k, n=30: " ".join(f"p{k}x{j}" for j in range(n))
    fill = lambda n: " ".join(f"f{rng.randrange(10**6)}" for _ in range(n))
    items = [(k, passage(k)) for k in range(8)]
    rows = [(9, None), (10, fill(50))]
    for k in range(7):
        rows.append((100 + k, f"{fill(400)} {passage(k)} {fill(140)} {passage(7)} {fill(400)}"))  # 3% of each, 6% of both
        rows.append((200 + k, f"{fill(900)} {passage(k)} {fill(900)} {passage(7)} {fill(900)}"))  # 2% of both
        halves = passage(k).split()
        rows.append((300 + k, f"{fill(900)} {' '.join(halves[:12])} {passage(7)} {' '.join(halves[12:24])} {fill(900)}"))  # closes up when 7 is cut
    docs = spark.createDataFrame([(i, t, len(t or ""), "s") for i, t in rows], "doc_id long, text string, n_chars long, source string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    one = sorted(map(tuple, decontam.clean(docs, bench).collect()))
    assert {r[0] for r in one} == {9, 10} | {200 + k for k in range(7)} | {300 + k for k in range(7)}
    assert all(r[2] == len(r[1] or "") and not re.search(r"p\d+x", r[1] or "") for r in one)
    for size in (60, 500):
        assert sorted(map(tuple, decontam.clean(docs, bench, max_chars=size).collect())) == one


def shingles(text):
    w = SPACE.findall(lower(text or ""))
    return frozenset(tuple(w[i : i + 4]) for i in range(len(w) - 3)) or (frozenset([tuple(w)]) if w else frozenset())


def linked(rows):
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    sets = [shingles(t) for _, t in rows]
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    return [(i, len(sets[k]), i if not sets[k] else least.get(find(k))) for k, (i, _) in enumerate(rows)]


def test_near_duplicates(docs, empty):
    got = neardup.classes(docs).collect()
    assert sorted(map(tuple, got), key=str) == sorted(linked(corpus()), key=str)
    assert neardup.classes(empty).count() == 0
    kept = neardup.keep(docs)
    assert kept.columns == docs.columns
    found = [(i, t, n) for (i, t), (_, n, c) in zip(corpus(), linked(corpus()), strict=True) if i is not None and i == c]
    want = Counter(i for i, _, n in found if not n) + Counter(i for i, _ in {(i, t) for i, t, n in found if n})
    assert Counter(r.doc_id for r in kept.collect() if r.doc_id is not None) == want and 10 not in want


def test_near_duplicates_of_null_and_reused_ids(spark):
    """Only a copy's own rows go, and every class keeps one document."""
    text = lambda k: " ".join(f"{k}w{j}" for j in range(40))
    near = lambda k: text(k).replace("w39", "other")
    rows = [(1, text("n")), (None, near("n")), (None, text("u")), (None, text("v")), (None, near("v"))]  # v's rows have no id
    rows += [(5, text("A")), (5, text("B")), (3, text("B")), (7, text("C")), (7, near("C")), (8, text("D")), (8, text("D")), (9, text("E")), (9, text("E").upper())]
    rows += [(None, None), (None, None), (4, ""), (4, "")]
    for size in (0, 500_000):
        kept = [tuple(r) for r in neardup.keep(spark.createDataFrame(rows, "doc_id long, text string"), broadcast_ids=size).collect()]
        found = Counter((i, t.split("w")[0].split("W")[0] if t else t) for i, t in kept)
        assert found == Counter({(1, "n"): 1, (None, "u"): 1, (None, "v"): 1, (5, "A"): 1, (3, "B"): 1, (7, "C"): 1, (8, "D"): 1, (9, "E"): 1, (None, None): 2, (4, ""): 2})


@pytest.mark.parametrize("hot", [200, 3])
def test_near_duplicates_of_a_large_group(spark, monkeypatch, hot):
    """More members than leaders, many of them linked with others than the leaders; frequent keys in parts or not."""
    monkeypatch.setattr(neardup, "HOT_ROWS", hot)
    rng = random.Random(3)
    base = [f"w{rng.randrange(900)}" for _ in range(60)]
    rows = []
    for k in range(120):
        words = list(base)
        for _ in range(rng.choice([0, 1, 1, 2, 3])):
            words[rng.randrange(60)] = f"v{rng.randrange(12)}"
        rows.append((1000 - k, " ".join(words)))
    got = neardup.classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert sorted(map(tuple, got)) == sorted(linked(rows))


def test_odd_sketches_estimate_similarity():
    rng = np.random.default_rng(1)
    both = rng.integers(0, 1 << 62, 900).astype(np.uint64)
    one, two = (np.unique(np.concatenate([both, rng.integers(0, 1 << 62, 50).astype(np.uint64)])) for _ in range(2))
    a, b = (neardup.odd_sketch(neardup.signature(x)) for x in (one, two))
    differ = int(np.unpackbits((a ^ b).view(np.uint8)).sum())
    assert abs(1 + neardup.SKETCH_BITS / (4 * neardup.SAMPLES) * math.log(1 - 2 * differ / neardup.SKETCH_BITS) - 0.9) < 0.12


def test_language_model(docs, empty):
    tokens = lambda t: lower(t or "").encode().split() + [b" "]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 10 == 0
    counts = Counter(w for i, t in corpus() if not held(i) for w in tokens(t))
    n, v = sum(counts.values()), len(counts)
    got = lm.score(docs, block_tokens=500).collect()
    assert len(got) == len(corpus())
    want = Counter()
    for i, t in corpus():
        w = tokens(t)
        want[(i, held(i), len(w), sum(counts[x] > 0 for x in w), n, round(sum(math.log10((counts[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w), 6))] += 1
    assert Counter((r.id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(r.score < 0 for r in got)
    one, many = ({(r.id, r.n_tokens): r.score for r in lm.score(docs, block_tokens=b).collect()} for b in (300, 10_000_000))
    assert all(abs(one[k] - many[k]) < 1e-9 * abs(many[k]) for k in one)  # blocks don't change scores
    assert lm.score(empty).count() == 0


def backoff_model(rows):
    """Brute force of the model: every word and pair seen before a word twice, whatever the corpus' size."""
    tokens = [lower(t or "").encode().split() + [b" "] for _, t in rows]
    training = [w for (i, _), w in zip(rows, tokens, strict=True) if i is None or zlib.crc32(str(i).encode()) % 10]
    count = [Counter(tuple(row[i : i + n]) for row in training for i in range(len(row) - n + 1)) for n in (1, 2, 3)]
    classes = Counter(min(n, 5) for n in count[0].values())
    root = lm.Root([classes[k] for k in range(1, 6)], sum(count[0].values()))
    sums = {}
    for grams in count[1:]:
        for g, n in grams.items():
            if n >= 2:
                s, k = sums.get(g[:-1], (0, 0))
                sums[g[:-1]] = (s + n, k + 1)

    def prob(history, w):
        if not history:
            return float(root.weights(np.array([count[0][(w,)]]))[0])
        below = prob(history[1:], w)
        if history not in sums:
            return below
        (s, k), all_ = sums[history], count[len(history) - 1][history]
        n = count[len(history)][(*history, w)]
        return (1 - (s - lm.DISCOUNT * k) / all_) * below + ((n - lm.DISCOUNT) / all_ if n >= 2 else 0.0)

    return tokens, count, prob


def backoff_scores(rows):
    tokens, _, prob = backoff_model(rows)
    return [sum(math.log10(prob(tuple(row[max(0, i - 2) : i]), w)) for i, w in enumerate(row)) for row in tokens]


def test_language_model_equals_brute_force(docs, spark):
    """Arcs of all repeated pairs and triples; blocks, shards, split histories and lanes change nothing."""
    rng = random.Random(8)
    rows = [(k, " ".join(f"w{int(300 * rng.random() ** 3)}" for _ in range(rng.choice([0, 1, 2, 300, 900])))) for k in range(300)]
    rows += [(400 + k, f"of the {'of the x%d ' % (k % 40) * 30}") for k in range(60)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    for given, frame, sizes in ((corpus(), docs, ((300, 200),)), (rows, frame, ((100_000, 10_000_000), (20_000, 3_000)))):
        want = Counter((str(i), round(x, 5)) for (i, _), x in zip(given, backoff_scores(given), strict=True))
        for block, shard in sizes:
            assert Counter((str(r.id), round(r.score, 5)) for r in lm.score(frame, block_tokens=block, shard_tokens=shard).collect()) == want
    typed = lm.score(frame.where("doc_id < 20").select(F.col("doc_id").cast("decimal(9,0)"), "text"))
    assert typed.schema["id"].dataType.simpleString() == "decimal(9,0)" and typed.count() == 20


def test_language_model_sums_to_one():
    """From the states of a text the weights of all words and the unknown one sum to one."""
    rng = random.Random(2)
    rows = [(None, " ".join(rng.choice("abcdef") for _ in range(60))) for _ in range(5)]
    _, count, prob = backoff_model(rows)
    events = [*(w for (w,) in count[0]), b"unknown"]
    for history in [(), (b"a",), (b"a", b"b"), (b"c", b"c"), (b"unknown", b"a")]:
        assert abs(sum(prob(history, w) for w in events) - 1) < 1e-9


def test_warc(spark):
    big = "x" * 1000
    rows = [(1, "http://a/", "same"), (2, "http://b/", "same"), (3, None, None), (4, "u", ""), (5, "u\r\nX: y", big), (6, "v", big), (7, "v", "né" * 300), (7, "v", "né" * 300), (7, "v", "other"), (None, "n", "only")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"digest": F.lit(0), "size": F.lit("s")})
    for least, digests in ((0, 400_000), (0, 0), (10, 400_000)):
        archive = warc.records(warc.plan(pages, min_bytes=least, broadcast_digests=digests), chunk=256)
        got = warc.read(archive).collect()
        last = {}
        for i, _, h in rows:
            last[h or ""] = max(i, last.get(h or "", i)) if i is not None else last.get(h or "")
        want = []
        for i, _, h in rows:
            raw = (h or "").encode()
            again = len(raw) >= least and sum((x[2] or "") == (h or "") for x in rows) > 1 and i != last[h or ""]
            want.append((i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if again else "response", last[h or ""] if again else None))
        assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert archive.agg(F.max(F.length("data"))).first()[0] < 1200
    out = io.BytesIO()
    size = warc.export(archive.where("record_id like '<urn:lectern:page:id=6:%'").orderBy("chunk_no").collect(), out)
    raw = out.getvalue()
    assert size == len(raw) and raw.startswith(b"WARC/1.1\r\n") and raw.endswith(big.encode()[-100:] + b"\r\n\r\n") and b"\r\nX: y" not in warc.header(5, "u\r\nX: y", "response", None, "00", 1, 1)
    assert warc.read(warc.records(warc.plan(pages.where("1 = 0")))).count() == 0
    named = pages.select(F.when(F.col("page_id") > 2, F.concat(F.lit("a:b "), "page_id")).otherwise("null").alias("page_id"), "url", "html")
    assert {r.page_id for r in warc.read(warc.records(warc.plan(named)), "string").collect()} == {"a:b 3", "a:b 4", "a:b 5", "a:b 6", "a:b 7", "null"}


def test_crf_marginals_equal_enumeration():
    rng = np.random.default_rng(2)
    counts = np.array([1, 4, 3])
    good, pairs = rng.normal(size=8), rng.normal(size=(2, 2))
    marginals, expected, total = crf.forward_backward(good, counts, pairs)
    at, moved = 0, np.zeros((2, 2))
    for k, c in enumerate(counts):
        weights, ones = [], []
        for m in range(2**c):
            y = [(m >> j) & 1 for j in range(c)]
            weights.append(math.exp(sum(good[at + j] for j in range(c) if y[j]) + sum(pairs[y[j], y[j + 1]] for j in range(c - 1))))
            ones.append(y)
        z = sum(weights)
        assert abs(math.log(z) - total[k]) < 1e-9
        for j in range(c):
            assert abs(sum(w for w, y in zip(weights, ones, strict=True) if y[j]) / z - marginals[at + j]) < 1e-9
            if j + 1 < c:
                for w, y in zip(weights, ones, strict=True):
                    moved[y[j], y[j + 1]] += w / z
        at += c
    assert np.allclose(moved, expected)


def test_classifier(spark, docs, empty):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    rows = []
    for k in range(600):
        lines = [" ".join(word() for _ in range(9)) + "." for _ in range(rng.randrange(1, 8))]
        if k % 3 == 0:
            lines = [x.upper().replace(" ", "!! ") if k % 2 else x.replace(" ", "$$$ ") for x in lines]
        rows.append((k, "\n".join(lines)))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 3 != 0)) for k in range(600)] + [(None, 1), (5, None)], "doc_id long, quality int")
    model = crf.train(frame, labels, per_class=100)
    got = {r.doc_id: r._score for r in crf.score_table(frame, model).collect()}
    held = [k for k in got if zlib.crc32(str(k).encode()) % 5 == 0]
    assert sum((got[k] >= 0.5) == (k % 3 != 0) for k in held) / len(held) > 0.97
    scores = crf.score_table(docs, model, keep_columns=True)
    assert scores.columns == [*docs.columns, "_score"] and scores.where("_score between 0 and 1").count() == docs.count()
    assert crf.score_table(empty, model).count() == 0
    assert np.isfinite(crf.train(frame, labels, per_class=100, sample_bytes=1).weights).all()  # one document at least
    long = frame.select("doc_id", F.when(F.col("doc_id") < 4, F.repeat(F.concat("text", F.lit("\n")), 300)).otherwise(F.col("text")).alias("text"))
    again = {r.doc_id: r._score for r in crf.score_table(frame, crf.train(long, labels, per_class=400)).collect()}
    assert sum((again[k] >= 0.5) == (k % 3 != 0) for k in held) / len(held) > 0.97  # texts of many lines are learned too
    none = crf.train(frame, labels.where("1 = 0"))
    assert crf.score_table(frame, none).agg(F.countDistinct("_score")).first()[0] == 1
