"""The operators against plain versions, over small tables with nulls, odd texts, ties and repeated rows."""

import hashlib
import itertools
import os
import random

import brute
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from liftspark.llm import bpe, decontaminate, exact_dedup, kneser_ney, language_id, license_scan, line_dedup, ngram_join, secret_scan, storage, textvec, url_filter
from liftspark.llm.components import components
from liftspark.llm.queries import ranks_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, texts, extra=True):
    """Documents with columns whose names clash with those that operators add."""
    df = spark.createDataFrame([(i, x, "en", "s", 0) for i, x in (texts.items() if isinstance(texts, dict) else enumerate(texts))], SCHEMA)
    if extra:
        for name in ("kept", "mark", "pair", "token", "score", "lang_pred", "row", "hash"):
            df = df.withColumn(name, F.lit("other"))
    return df


def words(r, n, vocabulary=60):
    return " ".join(f"w{r.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="module")
def mixed():
    """Near copies in chains and stars, exact copies, shared passages, and odd texts."""
    r = random.Random(5)
    texts = [None, "", "  \n\t ", "one", "ONE", "one two three", "a b c d e", "A  b\nc\td e", "é è", "x " * 400]
    passage = words(r, 60, 10**6)
    for _ in range(6):
        base = [f"v{r.randrange(10**6)}" for _ in range(r.choice((30, 80, 200)))]
        texts.append(" ".join(base))
        for _ in range(8):
            base = list(base)
            for _ in range(r.choice((1, 1, 2, 3))):
                base[r.randrange(len(base))] = f"v{r.randrange(10**6)}"
            texts.append(" ".join(base))
    for _ in range(20):
        texts.append(words(r, r.choice((5, 40, 100)), 10**6) + " " + passage)
    texts += [texts[12]] * 5 + [texts[15].upper()] * 2
    return texts


def test_components(spark):
    r = random.Random(3)
    pairs = [(r.randrange(300), r.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(400, 480)] + [(500, i) for i in range(501, 560)] + [(7, 7)]
    got = {x["node"]: x["label"] for x in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    want = brute.components({x for p in pairs if p[0] != p[1] for x in p}, [p for p in pairs if p[0] != p[1]])
    assert got == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_word_scanning_matches_patterns():
    texts = ["", "a", "Éa b", "x" * (textvec.BLOCK + 5) + " y", ("ab " * textvec.BLOCK)[: 2 * textvec.BLOCK], "A a-B\x0bc\x1cd", " lead", "漢字 と"]
    for table, pattern in ((textvec.BLANK, brute.SPACE_WORDS), (textvec.ALNUM, brute.WORDS)):
        seen = {}
        for i, j, buf, offsets in textvec.blocks(pa.array(texts)):
            w = textvec.Words(buf, offsets, table)
            for k in range(i, j):
                own = slice(w.first[k - i], w.first[k - i + 1])
                got = [buf[a:b].tobytes().decode() for a, b in zip(w.at[own], w.to[own], strict=True)]
                assert [brute.fold(x) for x in got] == pattern.findall(brute.fold(texts[k]))
                for x, h in zip(got, w.hash[own].tolist(), strict=True):
                    assert seen.setdefault(brute.fold(x), h) == h
        assert len(set(seen.values())) == len(seen)


def test_exact_dedup(spark, mixed):
    rows = [(i, t) for i, t in enumerate(mixed)] + [(500, "one"), (500, "one"), (3, "one"), (None, "one"), (None, "alone"), (501, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("kept", F.lit(1))
    for keep, best in (("max", max), ("min", min)):
        groups = {}
        for i, t in rows:
            groups.setdefault(t or "", []).append(i)
        low = float("-inf") if keep == "max" else float("inf")
        got = exact_dedup.exact_dedup(df, keep).collect()
        assert len(got) == len(rows)
        for text, ids in groups.items():
            own = [x for x in got if x["text_sha256"] == hashlib.sha256(text.encode()).hexdigest()]
            want = best(ids, key=lambda i: low if i is None else i)
            assert sorted(map(str, ids)) == sorted(str(x["doc_id"]) for x in own)
            assert {x["keep_id"] for x in own} == {want} and {x["group_size"] for x in own} == {len(ids)}
            assert sum(x["kept"] for x in own) == 1 and [x["doc_id"] for x in own if x["kept"]] == [want]
        left = exact_dedup.deduplicated(df, keep)
        assert left.columns == df.columns
        assert sorted(x["text"] or "" for x in left.collect()) == sorted(groups)
    assert exact_dedup.exact_dedup(df.limit(0)).count() == 0


def test_url_filter(spark):
    urls = ["http://example.net/", "http://a.example.net/en/x", "https://EXAMPLE.com/de/?q#f", "http://example.com/de", "http://x.org/fr/1", "http://org/fr/", "http://net", "http://net?x", "http://anet/", "ftp://a.b.net/?a/b", "no scheme", "", None, "://", "http://example.net./en/", "http://example.net/EN/", "x://é.net/ü#", "http://u@h.net:80/", "a://b://net/"]
    df = spark.createDataFrame(list(enumerate(urls)) + [(1, urls[1]), (None, "http://q.net/")], "page_id long, url string").withColumn("host", F.lit("h")).withColumn("rule", F.lit(2))

    def plain(url):
        url = url or ""
        rest = url.split("://", 1)[1] if "://" in url else ""
        host = brute.fold(__import__("re").match("[^/?#]*", rest)[0])
        path = __import__("re").match("[^?#]*", rest[len(host) :])[0]
        fits = [(len(h + p), len(h), v, h + p) for v, h, p in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fits, default=None)
        return host, path, best[3] if best else None, best[2] if best else "allow"

    rules = url_filter.rule_table(spark, url_filter.RULES)
    for limit in (url_filter.BROADCAST_RULES, 0):
        got = url_filter.url_filter(df, rules, broadcast_rules=limit).collect()
        assert sorted(((x["page_id"], x["host"], x["path"], x["rule"], x["verdict"]) for x in got), key=repr) == sorted(((i, *plain(u)) for i, u in [*enumerate(urls), (1, urls[1]), (None, "http://q.net/")]), key=repr)
    assert url_filter.url_filter(df, rules.limit(0)).where("rule is not null").count() == 0
    assert url_filter.url_filter(df.limit(0), rules).count() == 0


@pytest.fixture(scope="module")
def tokenizer():
    import public_tokenizers
    import tiktoken

    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(ranks_path()), special_tokens={})


def test_transducer_on_every_code_point_and_random_texts(tokenizer):
    points = [*range(0xD800), *range(0xE000, 0x110000)]
    texts = ["".join("a" + chr(p) + "1" + chr(p) + " " + chr(p) + chr(p) + "!" for p in points[i : i + 64]) for i in range(0, len(points), 640)]
    r = random.Random(1)
    bits = [" ", "  ", "\n", "'", "'s", "'re", "'ll", "ve", "a", "the", "ing", "é", "ß", "漢", "😀", "1", "²", "\t", "\x1c", "\x85", "!", "...", "A", "Th", "'t", " '", "xxxxx", "tion", "\r\n"]
    texts += ["".join(r.choices(bits, k=r.randint(0, 30))) for _ in range(1500)]
    texts += [None, "", "a" * 3000, " " * 500, "'" * 50, "a b " * (textvec.BLOCK // 3), "<|endoftext|>"]
    c = bpe.codec(ranks_path())
    for k, ids in c.encode(pa.array(texts)):
        assert list(ids) == tokenizer.encode_ordinary(texts[k] or "")
        cut = len(ids) // 2
        assert b"".join(c.decode([ids[:cut], ids[cut:]])) == (texts[k] or "").encode()


def test_bounded_tables_give_the_same(tokenizer, monkeypatch):
    monkeypatch.setattr(bpe, "MAX_STATES", 20)
    monkeypatch.setattr(bpe, "MAX_PAIRS", 20)
    monkeypatch.setattr(bpe, "MAX_POOL", 10)
    c = bpe.Codec(ranks_path())
    texts = ["incomprehensibilities and counterrevolutionaries"] * 3 + ["pseudopseudohypoparathyroidism"] * 2
    assert [list(ids) for _, ids in c.encode(pa.array(texts))] == [tokenizer.encode_ordinary(x) for x in texts]


def test_colliding_pieces_and_long_pieces_give_the_same(tokenizer, monkeypatch):
    r = random.Random(7)
    texts = [" ".join("".join(r.choices("abcdeéß漢", k=r.randrange(1, 30))) for _ in range(60)) for _ in range(8)]
    texts += ["".join(r.choices("abcdefgh", k=5000)), "x" * 3000, "ab" * 900, "=" * 500]
    c = bpe.Codec(ranks_path())
    c.bytes = np.zeros(256, dtype=np.uint64)  # all pieces of any length share one hash
    assert [list(ids) for _, ids in c.encode(pa.array(texts))] == [tokenizer.encode_ordinary(x) for x in texts]
    monkeypatch.setattr(bpe, "MAX_STATES", 30)
    c = bpe.Codec(ranks_path())
    assert [list(ids) for _, ids in c.encode(pa.array(texts))] == [tokenizer.encode_ordinary(x) for x in texts]


def test_neighbours_agree_with_plain_merging():
    r = random.Random(3)
    t = bpe.Transducer(bpe.load_ranks(ranks_path()))
    every = list(t.bytes_of)
    alike = [x for x in every if len(set(t.bytes_of[x])) <= 2 and len(t.bytes_of[x]) > 1]
    pairs = [(r.choice(every), r.choice(every)) for _ in range(8000)] + [(r.choice(alike), r.choice(alike)) for _ in range(8000)]
    for x in r.sample(every, 8000):
        b = t.bytes_of[x]
        k = r.randrange(1, len(b)) if len(b) > 1 else 0
        if b[:k] in t.ranks and b[k:] in t.ranks:
            pairs.append((t.ranks[b[:k]], t.ranks[b[k:]]))
    for a, b in pairs:
        assert t._follows(a, b) == (bpe.merge_pair_by_pair(t.ranks, t.bytes_of[a] + t.bytes_of[b]) == [a, b])


def test_utf8_machine_holds_unfinished_characters():
    data = "aé漢😀z".encode()
    for cuts in range(1 << (len(data) - 1)):
        m, out, part = bpe.Utf8Machine(), [], b""
        for i in range(len(data)):
            part += data[i : i + 1]
            if cuts >> i & 1:
                out.append(m.feed(part))
                part = b""
        out += [m.feed(part), m.close()]
        assert b"".join(out) == data
        for x in out:
            x.decode()
    m = bpe.Utf8Machine()
    assert m.feed(b"a\xff\xe6") + m.feed(b"b") + m.close() == b"a\xff\xe6b"


def test_encoded_rows_without_id_and_repeated(spark, tokenizer):
    rows = [(None, "a b"), (None, "a b"), (1, "a b"), (1, "a b"), (1, None), (2, "")]
    got = bpe.encode_documents(spark.createDataFrame(rows, "doc_id long, text string"), ranks_path()).collect()
    assert sorted((str(x["doc_id"]), x["n_tokens"]) for x in got) == sorted((str(i), len(tokenizer.encode_ordinary(t or ""))) for i, t in rows)
    assert bpe.encode_documents(frame(spark, []).limit(0), ranks_path()).count() == 0
    few = bpe.encode_documents(spark.createDataFrame(rows, "doc_id long, text string"), ranks_path(), states=20).collect()
    assert sorted(map(str, few)) == sorted(map(str, got))
    # A session's own batch size stays; one is set where there is none.
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    assert spark.conf.get(key) == storage.BATCH_BYTES
    spark.conf.set(key, "64m")
    assert storage.small_batches(spark).conf.get(key) == "64m"
    spark.conf.unset(key)


def test_encoding_that_loses_bytes_is_an_error():
    c = bpe.codec(ranks_path())
    text = np.frombuffer(b"a b", dtype=np.uint8)
    ids = next(c.encode(pa.array(["a b"])))[1]
    assert bpe._decoded(c, ids, text) == hashlib.sha256(b"a b").hexdigest()
    for wrong in (ids[:-1], ids[::-1], np.append(ids, ids)):
        with pytest.raises(ValueError):
            bpe._decoded(c, wrong, text)


def test_encoded_documents(spark, mixed, tokenizer):
    df = frame(spark, mixed[:30])
    got = {x["doc_id"]: x for x in bpe.encode_documents(df, ranks_path(), with_ids=True).collect()}
    assert len(got) == 30
    for i, t in enumerate(mixed[:30]):
        ids = tokenizer.encode_ordinary(t or "")
        packed = np.array(ids, dtype="<u4").tobytes()
        assert got[i]["n_tokens"] == len(ids) and bytes(got[i]["token_ids"]) == packed
        assert got[i]["ids_sha256"] == hashlib.sha256(packed).hexdigest() and got[i]["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()


def test_ngram_join(spark, mixed):
    sizes, want = brute.jaccard_components(list(enumerate(mixed)))
    rows = [(i, t) for i, t in enumerate(mixed)] + [(12, mixed[12]), (None, mixed[12])]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("token", F.lit(1))
    got = ngram_join.ngram_join(df).collect()
    assert len(got) == len(rows)
    for x in got:
        i = 12 if x["doc_id"] is None else x["doc_id"]
        assert x["n_shingles"] == sizes[i]
        assert x["component_id"] == (None if x["doc_id"] is None else want[i]), i
    assert sum(k != v for k, v in want.items()) > 40
    left = ngram_join.near_deduplicated(df).collect()
    assert sorted(x["doc_id"] for x in left if x["doc_id"] is not None) == sorted(set(want.values()))
    assert sum(x["doc_id"] is None for x in left) == 1
    assert ngram_join.ngram_join(df.limit(0)).count() == 0


def test_ngram_join_on_many_random_tables(spark, monkeypatch):
    """Chains, stars and near copies around the bound, many small tables in one: each seed has words of its own."""
    monkeypatch.setattr(ngram_join, "LARGE_STAR", 4)
    for round_ in range(3):
        texts, want = {}, {}
        for seed in range(24):
            r = random.Random(1000 * round_ + seed)
            own, pool = [], [[f"s{seed}w{r.randrange(10**4)}" for _ in range(r.choice((6, 12, 30, 80)))] for _ in range(r.choice((1, 2, 4)))]
            for _ in range(r.choice((5, 12, 25))):
                w = list(r.choice(pool))
                for _ in range(r.choice((0, 1, 1, 2, 4))):
                    k = r.randrange(len(w))
                    w[k : k + r.choice((0, 1, 2))] = r.choice(([], [f"s{seed}e{r.randrange(5)}"], [f"s{seed}n{r.randrange(10**6)}"]))
                    w = w or ["none"]
                if r.random() < 0.3:
                    pool.append(w)
                own.append(" ".join(w))
            ids = r.sample(range(10_000 * seed, 10_000 * seed + 9_999), len(own))
            texts |= dict(zip(ids, own, strict=True))
        _, want = brute.jaccard_components(list(texts.items()))
        assert 50 < len(set(want.values())) < len(want) - 50
        assert {x["doc_id"]: x["component_id"] for x in ngram_join.ngram_join(frame(spark, texts)).collect()} == want


def test_filters_pass_every_similar_pair():
    levels = (textvec.mix(np.arange(40, dtype=np.uint64)), np.arange(8, 48))

    r = np.random.default_rng(5)
    stopped = 0
    for n in (1, 2, 5, 9, 40, 200):
        for _ in range(120):
            pool = textvec.mix(np.arange(300 if n > 40 else 60, dtype=np.uint64))
            x = np.sort(r.choice(pool, n, replace=False))
            kept = r.choice(x, r.integers(0, n + 1), replace=False) if r.random() < 0.3 else r.choice(x, n - min(n, r.integers(0, 1 + n // 4)), replace=False)
            y = np.unique(np.concatenate([kept, r.choice(pool, r.integers(0, 1 + n // 5), replace=False)]))
            if not len(y):
                continue
            rows = []
            for s in (x, y):
                orders = ngram_join.Orders(*levels)
                parts = [np.unique((orders.prefix(s, j) >> np.uint64(32)).astype("<u4")) for j in range(1, ngram_join.ORDERS)]
                rows.append(np.concatenate([np.array([len(s), *map(len, parts)], dtype="<u4"), *parts]))
            ok = ngram_join.passes(*rows) and ngram_join.passes(*rows[::-1])
            assert ok or not ngram_join.similar(len(x), len(y), len(np.intersect1d(x, y)))
            stopped += not ok
    assert stopped > 30


def test_ngram_join_of_very_long_texts(spark):
    r = random.Random(31)
    base = [f"v{r.randrange(10**5)}" for _ in range(300_000)]
    near, far = list(base), list(base)
    for i in r.sample(range(len(base)), 3000):
        near[i] = "other"
    for i in r.sample(range(len(base)), 30_000):
        far[i] = "other"
    texts = {5: " ".join(base), 3: " ".join(near), 9: " ".join(far), 1: "x" * (textvec.BLOCK + 7), 2: "X" * (textvec.BLOCK + 7)}
    assert len(texts[5]) > textvec.BLOCK
    sizes, want = brute.jaccard_components(list(texts.items()))
    got = ngram_join.ngram_join(frame(spark, texts)).collect()
    assert {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in got} == {d: (sizes[d], want[d]) for d in texts} and want[5] == 3 and want[9] == 9 and want[2] == 1


def test_rows_of_one_doc_id_are_chosen_by_their_content(spark):
    rows = [(4, "a b c d e f", "p"), (4, "a b c d e f", "q"), (4, "u v w x y z", "p"), (5, "other words that stand alone here", None), (None, "a", "r")]
    kept = set()
    for k in range(4):
        df = spark.createDataFrame(rows[k:] + rows[:k], "doc_id long, text string, `odd.name` string").repartition(3)
        kept.add(frozenset(map(tuple, ngram_join.near_deduplicated(df).collect())))
    assert len(kept) == 1 and sorted(str(x[0]) for x in next(iter(kept))) == ["4", "5", "None"]


def test_salted_tokens_give_the_same(spark, mixed, monkeypatch):
    monkeypatch.setattr(ngram_join, "SALT_EVERY", 2)
    monkeypatch.setattr(ngram_join, "LEAST_FREQUENCY", 2)
    monkeypatch.setattr(ngram_join, "FLUSH", 100)
    _, want = brute.jaccard_components(list(enumerate(mixed)))
    assert {x["doc_id"]: x["component_id"] for x in ngram_join.ngram_join(frame(spark, mixed)).collect()} == want


def test_one_large_group_of_near_copies(spark):
    r = random.Random(11)
    base = [f"v{i}" for i in range(150)]
    texts = {7: " ".join(base)}
    for i in range(140):
        own = list(base)
        for _ in range(r.choice((1, 2, 3, 3, 4, 5, 6))):
            own[r.randrange(150)] = f"e{r.randrange(40)}"
        if r.random() < 0.3:
            own = own[: 150 - r.randrange(12)]
        texts[10 * i if i != 50 else 3] = " ".join(own)
    _, want = brute.jaccard_components(list(texts.items()))
    assert 3 < len(set(want.values())) < 100
    assert {x["doc_id"]: x["component_id"] for x in ngram_join.ngram_join(frame(spark, texts)).collect()} == want


def test_prefix_bound():
    for x in range(1, 60):
        assert ngram_join.needed(x) == next(n for n in range(x + 1) if 100 * n >= 80 * x)
        for y in range(x, 60):
            for both in range(x + 1):
                if ngram_join.similar(x, y, both):
                    assert both >= ngram_join.needed(y) and both >= ngram_join.needed(x)


def test_line_dedup(spark):
    r = random.Random(2)
    base = [words(r, 12, 10**6) for _ in range(6)]
    lines = list(base)
    for b in base * 4:
        w = b.split()
        p = r.randrange(len(w))
        k = r.randrange(4)
        lines.append(" ".join(w[:p] + ["new"] + w[p + (k != 0) :]) if k < 2 else " ".join(w[:p] + w[p + 1 :]) if k == 2 else b.upper())
    lines += ["a b", "a c", "a b", "x x x x x x x", "x x x x x x x x", "x x x x x x x x x", "", "  "]
    r.shuffle(lines)
    docs = {i: "\n".join(lines[3 * i : 3 * i + 3]) for i in range(len(lines) // 3 + 1)} | {100: None, 101: "", 102: "é \r\na b"}
    want = brute.line_classes(list(docs.items()))
    got = line_dedup.line_classes(frame(spark, docs)).collect()
    assert {(x["doc_id"], x["line_no"]): (x["n_words"], (x["class_doc_id"], x["class_line_no"])) for x in got} == want
    assert all(x["kept"] == ((x["doc_id"], x["line_no"]) == (x["class_doc_id"], x["class_line_no"])) for x in got)
    assert len({v for v in want.values()}) < len(want) - 15
    texts = {x["doc_id"]: x["text"] for x in line_dedup.without_repeated_lines(frame(spark, docs)).collect()}
    for i, t in docs.items():
        kept = [x for n, x in enumerate((t or "").split("\n")) if (i, n) not in want or want[i, n][1] == (i, n)]
        assert (texts[i] or "") == "\n".join(kept)
    nulls = spark.createDataFrame([(None, "a b"), (1, "a b")], "doc_id long, text string")
    assert [(x["doc_id"], x["class_doc_id"], x["kept"]) for x in sorted(line_dedup.line_classes(nulls).collect(), key=lambda x: x["doc_id"] or 0)] == [(None, None, True), (1, None, False)]
    assert line_dedup.line_classes(nulls.limit(0)).count() == 0


def test_one_edit():
    def a(*x):
        return np.array(x, dtype=np.uint64)

    assert line_dedup.within_one_edit(a(1, 2, 3), a(1, 9, 3)) and line_dedup.within_one_edit(a(1, 2, 3), a(1, 3)) and line_dedup.within_one_edit(a(2, 3), a(1, 2, 3)) and line_dedup.within_one_edit(a(1), a(1, 1))
    assert not line_dedup.within_one_edit(a(1, 2, 3), a(3, 2, 1)) and not line_dedup.within_one_edit(a(1, 2, 3), a(2, 3, 4)) and not line_dedup.within_one_edit(a(1), a(1, 2, 3))


def test_language_model(spark, mixed):
    texts = [t if t is None else t[:400] for t in mixed] * 2
    want = brute.bigram_scores(list(enumerate(texts)))
    got = kneser_ney.lm_score(frame(spark, texts)).collect()
    assert len(got) == len(texts)
    for x in got:
        w = want[x["doc_id"]]
        assert x["held_out"] == (brute.crc(x["doc_id"], 5) == 1)
        assert (x["n_tokens"], x["n_known"], x["train_tokens"]) == w[:3]
        assert x["base_score"] == pytest.approx(w[3], rel=1e-9) and x["score"] == pytest.approx(w[4], rel=1e-9)
    seen, unseen = sum(x["score"] for x in got if x["held_out"]), sum(x["base_score"] for x in got if x["held_out"])
    assert seen > unseen
    # Nothing to learn from, and nothing at all.
    alone = next(i for i in range(100) if brute.crc(i, 5) == 1)
    one = kneser_ney.lm_score(frame(spark, {alone: "a b"})).first()
    assert (one["train_tokens"], one["n_known"], one["base_score"], one["score"]) == (0, 0, 0.0, 0.0)
    assert kneser_ney.lm_score(frame(spark, []).limit(0)).count() == 0


def test_probabilities_sum_to_one(spark):
    docs = frame(spark, {i: x for i, x in zip([i for i in range(60) if brute.crc(i, 5) != 1], ["a b a", "b a c", "a a", "c", "a b c d"], strict=False)}).select("doc_id", "text")
    model = kneser_ney.fit(docs, F.lit(True))
    found = kneser_ney.Lookup(model)

    def h(x):
        data = np.frombuffer(x.encode(), dtype=np.uint8)
        return textvec.Words(data, np.array([0, len(data)]), textvec.BLANK).hash[0]

    vocabulary = np.array([*(h(x) for x in ("a", "b", "c", "d", "unknown")), np.uint64(kneser_ney.END)], dtype=np.uint64)
    for context in ("a", "c", "nowhere"):
        _, _, p = found.score(vocabulary, np.full(len(vocabulary), h(context), dtype=np.uint64))
        assert (10**p).sum() == pytest.approx(1.0)


def test_lost_model_files_are_an_error(spark):
    docs = frame(spark, ["a b c a b", "c d e"]).select("doc_id", "text")
    model = kneser_ney.fit(docs, F.lit(True))
    assert model.written
    for name in os.listdir(folder := storage.local_file(model.uri)):
        if name.startswith("pairs-"):
            os.remove(os.path.join(folder, name))
    contexts = tokens = np.arange(1, 200, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    with pytest.raises(FileNotFoundError):
        kneser_ney.Lookup(model).pairs(contexts, tokens)


def test_secret_scan(spark):
    r = random.Random(9)
    key = "".join(r.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", k=64))
    texts = [
        None, "", 'Password = "abcdef"', "token=secret=abcdefg", "token: key secret: abcdefgh", "api_key:'x.y/z+1=='", "APIKEY=12345", "ſecret=abcdefgh", "toKen=abcdefgh",
        "AKIA" + "A1" * 8, "AKIAAKIA" + "B2" * 6, "AKIA123", "xAKIA" + "Z" * 30, "deadbeef" * 3, "deadbee" * 3, "é" + "0a" * 20 + "F", "a token = " + "ab12" * 10 + " and", f"key {key} end", "internationalization is institutionalized " * 3, "/usr/local/share/documentation/index-2020",
    ]
    got = {x["doc_id"]: x for x in secret_scan.secret_scan(frame(spark, texts)).collect()}
    for i, t in enumerate(texts):
        counts, digest, told = brute.secrets(t)
        assert (got[i]["n_assign"], got[i]["n_access"], got[i]["n_hex"]) == counts and got[i]["base_sha256"] == digest, t
        assert [x for x in got[i]["spans"].split(",") if x and not x.startswith("random")] == [x for x in told.split(",") if x]
    random_spans = {i: x["spans"] for i, x in got.items() if "random" in x["spans"]}
    assert random_spans == {17: "random:4:68"}
    assert secret_scan.secret_scan(frame(spark, []).limit(0)).count() == 0


def test_randomness_battery():
    r = random.Random(4)
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    drawn = [secret_scan.statistic("".join(r.choices(alphabet, k=40))) for _ in range(300)]
    text = [secret_scan.statistic(("thequickbrownfoxjumpsoverthelazydog" * 3)[i : i + 40], "base62") for i in range(30)]
    assert np.mean(np.array(drawn) <= 6) > 0.95 and min(text) > 6
    assert secret_scan.encoding("deadBEEF00") == "base62" and secret_scan.encoding("deadbeef00") == "hex" and secret_scan.encoding("WXYZ2345====") == "base32" and secret_scan.encoding("a+b/c") == "base64"
    assert secret_scan.bounds(np.zeros((7, 80), dtype=int), np.zeros((7, 80), dtype=int)) == [-1] * 7


def test_random_keys_among_many_ordinary_names(spark):
    r = random.Random(21)
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    names = "usr local share lib python site packages index document request handler manager config service client buffer value image table report final draft user account order customer release build test module".split()

    def name():
        s, least, style = "", r.choice((20, 24, 32, 40, 64, 90)), r.randrange(4)
        while len(s) < least:
            w = r.choice(names)
            s += (w.capitalize(), "/" + w, w + "_", w.capitalize() + "-")[style] + (str(r.randrange(3000)) if r.random() < 0.2 else "")
        return s

    key = "".join(r.choices(alphabet, k=64))
    texts = [" ".join(name() for _ in range(20)) for _ in range(400)]
    without = [x["spans"] for x in secret_scan.secret_scan(frame(spark, texts)).collect()]
    assert not any(without)
    got = {x["doc_id"]: x["spans"] for x in secret_scan.secret_scan(frame(spark, [*texts, f"the key {key} ends"])).collect()}
    assert {i: x for i, x in got.items() if x} == {len(texts): "random:8:72"}
    # By themselves: most random strings of 64 characters and more are discoveries among 100,000 candidates that aren't.
    candidates = np.zeros((7, 80), dtype=int)
    candidates[:, 60] = 100_000 // 7
    for k, least in ((5, 64), (6, 128)):
        drawn = np.bincount([secret_scan.statistic("".join(r.choices(alphabet, k=least))) for _ in range(200)], minlength=80)
        one = candidates.copy()
        one[k, int(np.median(np.repeat(np.arange(80), drawn)))] += 1
        assert drawn[: secret_scan.bounds(np.zeros((7, 80), dtype=int), one)[k] + 1].sum() > 100


def test_license_scan(spark):
    texts = [None, "", "MIT License", "mit-license and mit, license", "the apache license (apache license)", "GNU General Public License v3, general public", "mit é license", "mitlicense", " ".join(["MIT license"] * 500), "Intro. " + license_scan.TEMPLATES[0][1].upper() + " outro", license_scan.TEMPLATES[6][1].replace("binary", "compiled"), "permission is hereby granted free"]
    got = {x["doc_id"]: x for x in license_scan.license_scan(frame(spark, texts)).collect()}
    for i, t in enumerate(texts):
        x = got[i]
        assert (x["n_words"], x["n_base"], x["first_word"], x["last_word"], x["base_labels"]) == brute.licenses(t), t
        assert 0 <= x["score"] <= 1
    assert got[9]["labels"] == "mit-text" and got[9]["score"] == 1.0 and got[10]["labels"] == "bsd-text" and 0.5 <= got[10]["score"] < 1
    assert got[11]["labels"] == "" and got[11]["score"] == 0.0 and got[2]["labels"] == "mit"
    assert license_scan.license_scan(frame(spark, []).limit(0)).count() == 0


def test_decontamination(spark):
    r = random.Random(6)
    items = [words(r, n, 10**6) for n in (16, 20, 40, 60, 9, 5, 3)] + ["", None]
    w = items[2].split()
    changed = " ".join(w[:10] + ["swap"] + w[11:25] + ["swop"] + w[26:])
    texts = {i: words(r, 80, 10**6) for i in range(10)}
    texts |= {20 + i: words(r, 30, 10**6) + " " + x.upper().replace(" ", ", ") + ". " + words(r, 30, 10**6) for i, x in enumerate(items) if x}
    texts |= {40: changed, 41: " ".join(w[:9]), 42: " ".join(w[:20]), 43: None, 44: "", 45: (items[1] + " ") * 200, 46: items[6]}
    benchmark = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    docs = frame(spark, texts)
    got = {(x["doc_id"], x["item_id"]): x for x in decontaminate.contaminated(docs, benchmark).collect()}
    want = {(d, i) for d, t in texts.items() for i, x in enumerate(items) if brute.contaminated(t, x)}
    assert set(got) == want and (40, 2) in want and (41, 2) not in want and (42, 2) in want and (46, 6) in want
    assert got[22, 2]["first_word"] == 30 and got[22, 2]["end_word"] == 70 and got[22, 2]["share"] == 1.0 and got[40, 2]["n_matched"] == 38
    left = decontaminate.decontaminated(docs, benchmark)
    assert left.columns == docs.columns and {x["doc_id"] for x in left.collect()} == set(texts) - {d for d, _ in want}
    assert decontaminate.contaminated(docs.limit(0), benchmark).count() == 0 and decontaminate.contaminated(docs, benchmark.limit(0)).count() == 0


def test_masks_hit_every_accepted_placement():
    """All placements of the tolerated substitutions, and of three in 14 words, where a window is accepted."""
    for n, k in [*((n, n - decontaminate._need(n, 13, 0.8)) for n in range(1, 14)), (14, 2), (14, 3), (16, 3), (18, 4)]:
        item = np.arange(1, n + 1, dtype=np.uint64)
        masks = [[j for j, m in enumerate(mask) if m == "1"] for mask in decontaminate._masks_of(n)]
        for places in itertools.combinations(range(n), k):
            text = item.copy()
            text[list(places)] = 0
            if decontaminate.agreement(text, item, 0, 13, 0.8):
                assert any(all(text[i + j] for j in m) for m in masks for i in range(n - m[-1])), (n, places)
    for window, agree in ((13, 0.9), (13, 0.5), (20, 0.8), (5, 0.8), (10, 0.7)):
        for n in (8, 9, 12, 20):
            size = min(window, n)
            masks = [[j for j, m in enumerate(mask) if m == "1"] for mask in decontaminate._masks_of(n, window, agree)]
            for places in map(set, itertools.combinations(range(size), size - decontaminate._need(n, window, agree))):
                assert any(places.isdisjoint(i + j for j in m) for m in masks for i in range(size - m[-1])), (window, agree, n, places)


def test_decontamination_by_brute_force(spark):
    r = random.Random(12)
    items = [words(r, n, 10**6) for n in range(8, 17) for _ in range(2)]
    texts = []
    for x in items:
        for k in (1, 1, 2, 2, 3, 4):
            w = x.split()
            for i in r.sample(range(len(w)), k):
                w[i] = f"other{r.randrange(10**6)}"
            texts.append(f"{words(r, 20, 10**6)} {' '.join(w)} {words(r, 20, 10**6)}")
    w = items[10].split()
    assert len(w) == 13
    texts.append(" ".join([*w[:7], "swap", *w[8:]]))
    benchmark = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(x["doc_id"], x["item_id"]) for x in decontaminate.contaminated(frame(spark, texts), benchmark).collect()}
    want = {(d, i) for d, t in enumerate(texts) for i, x in enumerate(items) if brute.contaminated(t, x)}
    assert got == want and (len(texts) - 1, 10) in want


def test_short_items_drop_no_ordinary_texts(spark):
    r = random.Random(13)
    long, three = words(r, 20, 10**6), words(r, 3, 10**6)
    items = [(0, "Paris"), (1, "of the"), (2, three), (3, long), (4, "canary-7f3a"), (4, "and")]
    texts = {i: f"{words(r, 30, 10**6)} paris and one of the {words(r, 30, 10**6)}" for i in range(20)}
    texts |= {30: f"{texts[0]} {three} end", 31: f"Paris {long}", 32: f"of the canary 7F3A {words(r, 5)}", 33: words(r, 30, 10**6)}
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = {(x["doc_id"], x["item_id"]) for x in decontaminate.contaminated(frame(spark, texts), benchmark).collect()}
    assert got == {(d, i) for d, t in texts.items() for i, x in items if brute.contaminated(t, x)} and len(got) > 60
    assert {x["doc_id"] for x in decontaminate.decontaminated(frame(spark, texts), benchmark).collect()} == {*range(20), 33}


def test_language_id(spark):
    r = random.Random(8)
    lexicon = {"aa": "lorem ipsum dolor sit amet elit sed".split(), "bb": "zwk grzyb trzy szcz krzyk".split(), "cc": "ακτή θάλασσα νησί".split()}
    rows = []
    for i in range(240):
        lang = ("aa", "bb", "cc")[i % 3]
        rows.append((i, " ".join(r.choices(lexicon[lang], k=r.choice((5, 40, 200)))), lang))
    rows += [(900, None, "aa"), (901, "", "bb"), (902, "123 !? 😀", "cc"), (903, "lorem ipsum dolor", None), (None, "lorem ipsum dolor sit amet", "bb"), (3, "lorem", "aa")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("x"))
    got = language_id.language_id(df).collect()
    assert len(got) == len(rows)
    truth = {i: lang for i, _, lang in rows[:240]}
    for x in got:
        assert 0 <= x["score"] <= 1
        if x["doc_id"] in truth:
            assert x["lang_pred"] == truth[x["doc_id"]] and x["held_out"] == (brute.crc(x["doc_id"], 4) == 2) and not x["rejected"]
        if x["doc_id"] in (900, 901, 902):
            assert (x["lang_pred"], x["score"], x["rejected"]) == ("und", 0.0, True)
    kept = language_id.accepted(df)
    assert kept.columns == df.columns and kept.count() == len(rows) - 3
    assert {x["lang_pred"] for x in language_id.language_id(df.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert language_id.language_id(df.limit(0)).count() == 0


def test_language_id_learns_every_label(spark):
    r = random.Random(17)
    rows, n = [], 0
    for k in range(230):
        lexicon = ["".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=6)) for _ in range(8)]
        for _ in range(2 if k == 0 else 4):
            while brute.crc(n, 4) == 2:  # none held out
                n += 1
            rows.append((n, " ".join(r.choices(lexicon, k=60)), f"l{k}"))
            n += 1
    rows.append((n + 1 if brute.crc(n, 4) == 2 else n, "123", "l0"))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    everything = F.lit(True)
    model = language_id.fit(df, everything)
    assert len(model.languages) == 230
    got = {x["doc_id"]: x["lang_pred"] for x in language_id.language_id(df).collect()}
    assert all(got[d] == lang for d, _, lang in rows[:-1])
    # One text of each label is learned where the sample allows no more; all are counted.
    small = language_id.fit(df, everything, sample=50)
    assert len(small.languages) == small.centroids.shape[1] == 230 and np.array_equal(small.idf, model.idf)
    x = np.concatenate([x for _, x, _, _ in language_id.counts(pa.array([t for _, t, _ in rows[:-1]]))])
    assert np.allclose(model.idf, np.log((1 + len(x)) / (1 + (x > 0).sum(axis=0))) + 1)


def test_shared_folder_is_the_session_s(spark, tmp_path):
    table = storage.written(spark.range(3), "t")
    assert table.count() == 3 and table.inputFiles()[0].startswith("file:")
    assert storage.without(spark.range(5), storage.written(spark.range(2), "d"), "id").count() == 3
