"""The operators of the llm subpackage against brute force, round trips and edge cases."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from speechloom.llm import common, decontaminate, editcount, neardup, packing, perplexity, personal, quality, queries, roles, stages, urlrules, warc, wordbpe

DOC = "doc_id long, text string, lang string, source string, n_chars long"
TOKENIZER = queries.tokenizer_file()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels", "conversations", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, repeated rows and ids, a column whose name clashes."""
    long = "the quick brown fox " * 20_000
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (None, "one two three four five six", "en", "s", 3), (3, long, "xx", "s", 9), (4, "same words here again and again", "en", "s", 1), (4, "same words here again and again", "en", "s", 1), (5, "same words here again and again", None, "s", 1), (6, " \n\t ", "en", "s", 4), (7, "x" * 100_000, "en", "s", 5)]
    return spark.createDataFrame(rows, DOC).withColumn("score", F.lit("clash")).withColumn("component_id", F.lit("clash"))


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_equals_duckdb(spark, sf, duck, name):
    df = queries.QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    found = duck.execute(queries.ORACLES[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    assert sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str) == sorted((tuple(r[names.index(c)] for c in columns) for r in found.fetchall()), key=str)


# 1 packing


def check_packed(texts, rows):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(TOKENIZER)
    want = Counter()
    for doc, text in texts:
        ids = np.array([*tok.encode(text or "", add_special_tokens=False).ids, 1], dtype="<u4")
        want[doc, len(ids), ids.tobytes()] += 1
    by_doc = {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
    for (doc, n, data), times in want.items():
        pieces = sorted((r for r in by_doc[doc] if r.doc_tokens == n), key=lambda r: r.start)
        assert sum(r.length for r in pieces) == n * times
        for r in pieces:
            assert zlib.crc32(data[4 * r.start : 4 * (r.start + r.length)]) == r.ids_crc32
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append(r)
    padding = 0
    for s in sequences.values():
        at = 0
        for r in sorted(s, key=lambda r: r.offset):
            assert r.offset == at and r.length > 0
            at += r.length
        assert at <= 2048 and len(s) <= 256
        padding += 0 if at & (at - 1) == 0 else 2048 - at
    return padding


def test_packing(spark, sf, odd):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = queries.op1_vector_packing(spark, sf).collect()
    assert check_packed([(r.doc_id, r.text) for r in docs.collect()], rows) == 0
    rows = packing.pack_documents(odd, TOKENIZER).collect()
    check_packed([(r.doc_id, r.text) for r in odd.collect()], rows)
    assert packing.pack_documents(odd.limit(0), TOKENIZER).count() == 0


def test_vector_bins_respect_all_limits(spark):
    rng = np.random.default_rng(1)
    tokens = rng.integers(1, 900, 300)
    demand = np.stack([tokens, np.ones(300, dtype=int), rng.integers(0, tokens + 1)], axis=1)
    size = np.array([2048, 5, 700])
    demand[:, 2] = np.minimum(demand[:, 2], 700)
    bins = packing.dot_product_bins(demand, size)
    assert sorted(k for b in bins for k, _, _ in b) == list(range(300))
    for b in bins:
        assert (demand[[k for k, _, _ in b]].sum(axis=0) <= size).all()
    least = max(-(-demand.sum(axis=0) // size))
    assert len(bins) <= 1.2 * least
    with pytest.raises(ValueError):
        packing.dot_product_bins(np.array([[3000, 1, 0]]), size)
    df = spark.createDataFrame([("a", 10, 5), ("b", None, None), ("c", 2000, 100)], "example_id string, n_tokens long, n_loss long")
    assert {r.id for r in packing.pack_examples(df, 2048, 4, 2048).collect()} == {"a", "b", "c"}


def test_word_encoder_equals_the_library():
    from tokenizers import Tokenizer

    tok, own = Tokenizer.from_file(TOKENIZER), wordbpe.encoder(TOKENIZER)
    rng = random.Random(4)
    signs = "aB'sſßÉéΣςİ12²½_-!. \t\n\x1c\x85\xa0中文ﬁ"
    for k in range(400):
        text = "".join(rng.choice(signs) for _ in range(rng.randint(0, 30))) + ("<|endoftext|>x" if k % 40 == 0 else "")
        assert np.frombuffer(own.encode(text.encode()), "<u4").tolist() == tok.encode(text, add_special_tokens=False).ids


def test_each_code_point_has_the_ids_of_the_library():
    from tokenizers import Tokenizer

    tok, own = Tokenizer.from_file(TOKENIZER), wordbpe.encoder(TOKENIZER)
    signs = [chr(c) for c in [*range(128, 0x3400), *range(0xA000, 0xAC00), *range(0xD7B0, 0xD800), *range(0xF900, 0x11000), *range(0x1E000, 0x1F000)]]
    texts = [f"a{s}b" for s in signs] + ["".join(random.Random(k).choices(signs, k=4)) for k in range(4000)]
    found = [np.frombuffer(own.encode(t.encode()), "<u4").tolist() for t in texts]
    assert found == [e.ids for e in tok.encode_batch(texts, add_special_tokens=False)]


# 2 role repair


def cheapest(turns):
    """Brute force: every labelling and merging, with the empty turns that each then needs."""
    best = roles.FAR
    n = len(turns)
    for choice in itertools.product(range(4), repeat=n):  # 0 to 2: a turn of that role; 3: merged
        state, cost = roles.START, 0
        for role, c in zip(turns, choice, strict=True):
            if c == 3:
                if state == roles.START:
                    break
                cost += roles.MERGE + (0 if role == state else roles.LABEL if role is None else roles.RELABEL)
                continue
            found = roles.ROUTES[state].get(c)
            if found is None:
                break
            cost += found[0] + (0 if role == c else roles.LABEL if role is None else roles.RELABEL)
            state = c
        else:
            best = min(best, cost + roles.ENDING[state][0])
    return best


def test_role_repair_is_cheapest(spark, monkeypatch):
    rng = random.Random(6)
    names = [None, "user", "assistant", "system", "tool"]
    chats = {k: [rng.choice(names) for _ in range(rng.randint(1, 6))] for k in range(60)}
    rows = [(k, t, r, f"{k}-{t}") for k, turns in chats.items() for t, r in enumerate(turns)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("cost", F.lit("clash"))
    for block in (512, 2):
        monkeypatch.setattr(roles, "BLOCK_TURNS", block)
        out = roles.repair_chats(df).collect()
        assert len(out) == len(rows)
        for k, turns in chats.items():
            mine = sorted((r for r in out if r.conv_id == k), key=lambda r: r.position)
            assert {r.cost for r in mine} == {cheapest([roles.role_number(x) for x in turns])}
            assert [r.turn for r in mine] == list(range(len(turns)))
            text = "".join(r.rendered for r in mine)
            said = re.findall(r"<\|im_start\|>(\w+)\n(.*?)<\|im_end\|>\n", text, re.S)
            assert "".join(f"<|im_start|>{a}\n{b}<|im_end|>\n" for a, b in said) == text
            order = [a for a, _ in said]
            order = order[1:] if order[0] == "system" else order
            assert order == ["user", "assistant"] * (len(order) // 2) and len(order) % 2 == 0
            assert [x for _, b in said for x in b.split("\n") if x] == [f"{k}-{t}" for t in range(len(turns))]


def first_cheapest(turns):
    """Brute force over all ways in the order of their moves: the first one of least cost."""
    best, kept = roles.FAR, None

    def go(k, state, cost, way):
        nonlocal best, kept
        if k == len(turns):
            if cost + roles.ENDING[state][0] < best:
                best, kept = cost + roles.ENDING[state][0], way
            return
        for c, new, action, path in roles.moves(state, turns[k]):
            go(k + 1, new, cost + c, [*way, (roles.ROLES[new], action, path)])

    go(0, roles.START, 0, [])
    return kept


@pytest.mark.parametrize(("block", "partitions"), [(512, 1), (1, 3), (2, 211), (3, 4)])
def test_ties_do_not_depend_on_cuts(spark, monkeypatch, block, partitions):
    rng = random.Random(9)
    names = [None, "user", "assistant", "system"]
    chats = {k: [rng.choice(names) for _ in range(rng.randint(1, 6))] for k in range(80)} | {90: ["user"] + [None] * 4}
    rows = [(k, t, r, f"{k}-{t}") for k, turns in chats.items() for t, r in enumerate(turns)]
    monkeypatch.setattr(roles, "BLOCK_TURNS", block)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        out = roles.repair_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    for k, turns in chats.items():
        mine = sorted((r for r in out if r.conv_id == k), key=lambda r: r.position)
        want = first_cheapest([roles.role_number(x) for x in turns])
        assert [(r.new_role, r.action) for r in mine] == [w[:2] for w in want], k


def test_role_repair_edges(spark):
    df = spark.createDataFrame([(None, None, None, None), (1, 0, "user", "a"), (1, 0, "user", "a"), (1, 0, "user", "b")], "conv_id long, turn long, role string, text string")
    out = roles.repair_chats(df).collect()
    assert len(out) == 3 and sum(r.conv_id is None for r in out) == 1
    assert roles.repair_chats(df.limit(0)).count() == 0
    assert roles.whole_chats(roles.repair_chats(df)).count() == 2


# 3 personal data

EMAIL, IP = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD, PHONE = re.compile(r"[0-9]([\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain_spans(text):
    out = [("email", *m.span()) for m in EMAIL.finditer(text)]
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(int(x) <= 255 for x in m.group().split("."))]
    for m in CARD.finditer(text):
        d = re.sub("[^0-9]", "", m.group())
        if 13 <= len(d) <= 19 and personal.luhn(d):
            out.append(("card", *m.span()))
    return out + [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= len(re.sub("[^0-9]", "", m.group())) <= 15]


def test_base_spans():
    rng = random.Random(2)
    for _ in range(20_000):
        text = "".join(rng.choice("ab@@..1234567890-- +()%é\n") for _ in range(rng.randint(0, 60)))
        assert plain_spans(text) == personal.base_spans(text)
    assert personal.base_spans("1" * 50_000 + "a" * 50_000 + "@") == []


def test_contexts_and_overlaps_are_exact():
    rng = random.Random(5)
    for _ in range(2000):
        text = "".join(rng.choice(["a", "B", " ", "\n", "x" * 300, "9"]) for _ in range(rng.randint(0, 12)))
        end = rng.randint(0, len(text))
        words, whole = text[:end].lower().split(), text[:end].encode()
        assert [w.decode() for w in personal.words_before(text, end)] == words[-2:], (whole, end)
        spans = [("x", a, a + rng.randint(1, 9)) for a in rng.sample(range(60), rng.randint(0, 8))]
        start = rng.randint(0, 60)
        assert personal.Spans(spans).overlap(start, start + 3) == any(a < start + 3 and start < b for _, a, b in spans)


def test_patterns_discover_unseen_identifiers(spark, odd):
    known = [(k, f"lorem ipsum customer mail user{k}@mail.example.com dolor sit") for k in range(30)]
    unseen = [(100 + k, f"amet customer mail u5er-{k}x77 dolor 12345678 sit") for k in range(3)]
    plain = [(200 + k, f"in the year 2024{k}00 of the lorem 9{k}77001 ipsum") for k in range(20)]
    df = spark.createDataFrame(known + unseen + plain, "doc_id long, text string")
    rows = {r.doc_id: r for r in personal.find_personal_data(df).collect()}
    for k, text in known + unseen + plain:
        base = ",".join(f"{a}:{b}:{c}" for a, b, c in plain_spans(text))
        assert rows[k].base_sha256 == hashlib.sha256(base.encode()).hexdigest()
    assert all(rows[k].spans.startswith("id:19:") and rows[k].n_found == 1 for k, _ in unseen)
    assert all(rows[k].spans == "" for k, _ in plain)
    assert "[ID]" in personal.mask(unseen[0][1], personal.learn_patterns(df))
    assert personal.find_personal_data(odd).count() == odd.count()
    assert personal.find_personal_data(odd.limit(0)).count() == 0
    assert personal.mask_personal_data(odd).where("text is null").count() == 1


# 4 perplexity


def test_rule_counts(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    rows = {r.doc_id: r for r in queries.op4_perplexity_bands(spark, sf).collect()}
    for d in docs:
        data = (d.text or "").encode()
        words = data.split()
        seen, dup = set(), 0
        for line in data.split(b"\n"):
            if line.split():
                dup += line in seen
                seen.add(line)
        windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
        times = Counter(windows)
        repeat = len({j for i, w in enumerate(windows) if times[w] > 1 for j in (i, i + 1, i + 2)})
        r = rows[d.doc_id]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(words), sum(len(w.decode()) for w in words), sum(c in "#*$%&|<>" for c in d.text or ""), dup, repeat)
        assert r.base_failed == (len(words) < 50 or 100 * repeat > 50 * len(words)) and not (r.base_failed and r.kept)


def plain_kneser_ney(texts):
    """Probability of a code point after a context by dictionaries and recursion, from the definition."""
    order, edge = perplexity.ORDER, perplexity.EDGE
    counts = {order: Counter()}
    for t in texts:
        whole = edge * (order - 1) + t + edge
        counts[order].update(whole[i : i + order] for i in range(len(whole) - order + 1))
    for k in range(order - 1, 0, -1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])
    cut = {}
    for k, table in counts.items():
        n = [sum(c == i for c in table.values()) for i in range(5)]
        y = n[1] / (n[1] + 2 * n[2]) if n[1] else 0
        cut[k] = [0, *(min(max(i - (i + 1) * y * n[i + 1] / n[i], 0), i - 0.01) for i in (1, 2, 3))] if min(n[1:]) else [0, 0.5, 0.75, 0.9]
    contexts = {k: {} for k in counts}
    for k, table in counts.items():
        for g, c in table.items():
            contexts[k].setdefault(g[:-1], []).append((g, c))

    def p(context, sign):
        k = len(context) + 1
        below = p(context[1:], sign) if context else 1 / (len(counts[1]) + 1)
        if context not in contexts[k]:
            return below
        total = sum(c for _, c in contexts[k][context])
        entries = {g: c - cut[k][min(c, 3)] for g, c in contexts[k][context] if k < order or c >= perplexity.LEAST_COUNT}
        return entries.get(context + sign, 0) / total + max(1 - sum(entries.values()) / total, 1e-9) * below

    return p


def test_kneser_ney_equals_a_plain_version(spark, monkeypatch):
    rng = random.Random(0)
    made = {lang: ["".join(rng.choices("abcü d\U0001f600", k=rng.randint(0, 120))) for _ in range(12)] for lang in ("en", "")}
    rows = [(k, t, lang) for lang, texts in made.items() for k, t in enumerate(texts)]
    entries = {r["hash"]: r["value"] for r in perplexity.train(spark.createDataFrame(rows, "id long, text string, lang string").select("lang", "text")).collect()}
    keys = np.array(sorted(k % (1 << 64) for k in entries), dtype=np.uint64)
    find = perplexity.lookup(keys, np.array([entries[int(k)] for k in keys.view(np.int64)], dtype=np.float32))
    signs = sorted({c for texts in made.values() for t in texts for c in t} | {perplexity.EDGE})
    for lang, texts in made.items():
        p = plain_kneser_ney(texts)
        seed = perplexity.language_seed(lang)
        for context in ("\0\0\0\0", "ab d", "zzzz", "\0\0\0a", texts[3][:4]):
            grams = np.array([[ord(c) for c in context + s] for s in [*signs, "?"]], dtype=np.uint32)
            found = np.exp(perplexity.log_probability(grams, seed, find))
            assert np.allclose(found, [p(context, s) for s in [*signs, "?"]], rtol=1e-4)
            assert abs(found.sum() - 1) < 1e-3  # the last one is any other code point
        for size in (1 << 18, 9):
            monkeypatch.setattr(perplexity, "BLOCK_CHARS", size)
            scores = perplexity.text_scores([lang] * len(texts), texts, find)
            for t, s in zip(texts, scores, strict=True):
                whole = "\0" * 4 + t + "\0"
                assert abs(s + sum(np.log(p(whole[i : i + 4], whole[i + 4])) for i in range(len(t) + 1))) < 1e-2


def test_shards_give_the_scores_of_the_broadcast(spark, sf, monkeypatch):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = {r.doc_id: (round(r.log_perplexity, 6), r.kept) for r in perplexity.perplexity_rules(docs).collect()}
    monkeypatch.setattr(perplexity, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(perplexity, "SHARD_ENTRIES", 9000)
    monkeypatch.setattr(perplexity, "BLOCK_TEXTS", 30)
    assert {r.doc_id: (round(r.log_perplexity, 6), r.kept) for r in perplexity.perplexity_rules(docs).collect()} == want


def test_perplexity_bands(spark, odd):
    rng = random.Random(1)
    words = ["".join(rng.choice("abcdefgh") + rng.choice("aeiou") for _ in range(3)) for _ in range(300)]
    clean = [(k, " ".join(rng.choice(words) for _ in range(200)), "en") for k in range(150)]
    junk = [(900 + k, " ".join("".join(rng.choice("qxzjvkw0987#%&") for _ in range(7)) for _ in range(80)), "en") for k in range(3)]
    rows = {r.doc_id: r for r in perplexity.perplexity_rules(spark.createDataFrame(clean + junk, "doc_id long, text string, lang string")).collect()}
    assert all(rows[k].kept for k, _, _ in clean) and not any(rows[k].kept for k, _, _ in junk)
    assert all(rows[k].log_perplexity > rows[k].high for k, _, _ in junk)
    rare = [(2000 + k, " ".join(rng.choice(words) for _ in range(200)), f"l{k % 3}") for k in range(30)]  # languages of ten texts each
    rows = {r.doc_id: r for r in perplexity.perplexity_rules(spark.createDataFrame(clean + rare, "doc_id long, text string, lang string")).collect()}
    assert len({rows[k].low for k, _, _ in rare}) > 1 and all(rows[k].kept for k, _, _ in rare)
    assert perplexity.perplexity_rules(odd).count() == odd.count()
    assert perplexity.perplexity_rules(odd.limit(0)).count() == 0


# 5 near-duplicates


def exact_components(rows, width, percent):
    sets = []
    for _, text in rows:
        w = (text or "").encode().lower().split()
        sets.append({tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set())
    least = [d for d, _ in rows]
    changed = True
    links = [(a, b) for a in range(len(rows)) for b in range(a) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    while changed:
        changed = False
        for a, b in links:
            if least[a] != least[b]:
                least[a] = least[b] = min(least[a], least[b])
                changed = True
    return {d: (len(s), c, d == c) for (d, _), s, c in zip(rows, sets, least, strict=True)}


def family(rng, words, n, edits):
    base = [rng.choice(words) for _ in range(80)]
    out = []
    for _ in range(n):
        own = list(base)
        for _ in range(rng.randint(0, edits)):
            own[rng.randrange(len(own))] = rng.choice(words)
        out.append(" ".join(own))
    return out


@pytest.mark.parametrize("tile", [1024, 4])
def test_near_duplicates_are_exact(spark, monkeypatch, tile):
    rng = random.Random(tile)
    words = [f"W{k}" for k in range(500)]
    texts = family(rng, words, 60, 6) + family(rng, words, 20, 2) + [" ".join(rng.choice(words) for _ in range(60)) for _ in range(60)] + ["a b", "A B", "c", "", None, "a b c d e", "a b c d e f", "one two three four five six seven eight nine ten", "ONE two three four five six seven eight nine ten"]
    rows = list(enumerate(texts, 10))
    monkeypatch.setattr(neardup, "TILE", tile)
    monkeypatch.setattr(neardup, "SMALL_EDGES", 200_000 if tile > 4 else 3)
    found = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width=4, percent=80).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in found} == exact_components(rows, 4, 80)


def test_near_duplicate_tables(spark, sf, odd):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    found = queries.op5_minmax_neardup(spark, sf).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in found} == exact_components(rows, 4, 80)
    out = neardup.near_duplicates(odd, width=4).collect()
    assert len(out) == odd.count()
    assert {(r.doc_id, r.component_id, r.kept) for r in out if r.doc_id in (4, 5, None)} == {(4, 4, True), (5, 4, False), (None, None, True)}
    assert neardup.near_duplicates(odd.limit(0)).count() == 0


def test_repeated_ids_with_different_texts_lose_no_link(spark):
    a, b = " ".join(f"a{k}" for k in range(60)), " ".join(f"b{k}" for k in range(60))
    rows = [(1, a), (1, b), (2, a + " x"), (3, b + " y"), (4, "c d e f g h"), (5, None), (1, None), (6, "p q r s"), (6, "p q r s"), (6, "t u v w")]
    found = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width=4, percent=80).collect()
    assert len(found) == len(rows)
    assert {(r.doc_id, r.component_id, r.kept) for r in found} == {(1, 1, True), (2, 1, False), (3, 1, False), (4, 4, True), (5, 5, True), (6, 6, True)}
    rng = random.Random(21)
    words = [f"W{k}" for k in range(300)]
    texts = family(rng, words, 40, 6) + family(rng, words, 40, 6) + [" ".join(rng.choice(words) for _ in range(30)) for _ in range(40)]
    rows = [(rng.randrange(60), t) for t in texts]  # about half of the ids repeat
    found = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width=4, percent=80).collect()
    single = exact_components([(k, t) for k, (_, t) in enumerate(rows)], 4, 80)
    least = {d: d for d, _ in rows}
    for _ in rows:  # ids tie their rows, texts their groups
        for k, (d, _) in enumerate(rows):
            low = min(least[d], *(least[rows[j][0]] for j in range(len(rows)) if single[j][1] == single[k][1]))
            least[d] = low
    assert {(r.doc_id, r.component_id) for r in found} == set(least.items())


def test_heavy_classes_are_joined_like_others(spark, monkeypatch):
    rng = random.Random(2)
    words = [f"W{k}" for k in range(300)]
    rows = list(enumerate(["one text of many copies and more"] * 50 + family(rng, words, 40, 5) + ["two words"] * 3, 5))
    want = exact_components(rows, 4, 80)
    for heavy in (10_000, 4, 1):
        monkeypatch.setattr(common, "HEAVY", heavy)
        found = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width=4, percent=80).collect()
        assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in found} == want


def test_min_and_max_estimate_the_similarity():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 1000, dtype=np.uint64)
    other = np.concatenate([base[:800], rng.integers(0, 1 << 63, 200, dtype=np.uint64)])
    a, b = neardup.signatures([np.unique(base), np.unique(other)])
    assert abs((a == b).mean() - 800 / 1200) < 0.12


# 6 URLs


def listed_rules(spark, rules=None, patterns=None):
    rules = urlrules.HOST_PATH_RULES if rules is None else rules
    patterns = urlrules.PATTERN_RULES if patterns is None else patterns
    return urlrules.listed(spark, ["verdict", "rule"], rules), urlrules.listed(spark, ["pattern"], [(p,) for p in patterns])


def plain_pattern(pattern, target):
    """Brute force: the pattern is tried at each place, sign by sign."""
    p, t = pattern.lower(), target.lower()
    host = p.startswith("||")
    begin = host or p.startswith("|")
    p = p[2:] if host else p[1:] if begin else p
    end = p.endswith("|")
    p = p[:-1] if end else p

    def go(i, at):
        if i == len(p):
            return not end or at == len(t)
        if p[i] == "*":
            return any(go(i + 1, j) for j in range(at, len(t) + 1))
        if p[i] == "^":
            return (at == len(t) and go(i + 1, at)) or (at < len(t) and not (t[at].isascii() and (t[at].isalnum() or t[at] in "_.%-")) and go(i + 1, at + 1))
        return at < len(t) and p[i] == t[at] and go(i + 1, at + 1)

    places = [0] if begin else range(len(t) + 1)
    if host:
        places = [0, *(k + 1 for k, c in enumerate(t) if c == "." and "/" not in t[:k])]
    return any(go(0, k) for k in places)


def test_rules_equal_brute_force(spark):
    rng = random.Random(12)
    part = lambda: rng.choice(["ab", "a", "Foo", "x9", "b-a", "é", "--", "a_b", "c+d"])
    urls = [f"http://{'.'.join(part() for _ in range(rng.randint(1, 3)))}/{'/'.join(part() for _ in range(rng.randint(0, 3)))}" for _ in range(150)]
    rules = list({(rng.choice(["allow", "block"]), f"{'.'.join(part().lower() for _ in range(rng.randint(1, 2)))}/{rng.choice(['', part(), part() + '/', part()[:1]])}") for _ in range(25)})
    patterns = [rng.choice(["", "|", "||", ""]) + "".join(rng.choice([part(), "*", "^", "/", "."]) for _ in range(rng.randint(1, 4))) + rng.choice(["", "", "|", "^"]) for _ in range(25)] + ["--", "*"[:0] + "Foo/"]
    patterns = [p for p in patterns if p.strip("|*")]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    for chosen in (rules, []), (rules, patterns), ([], patterns[:6]), ([("block", "ab/Foo/"), ("allow", "a/")], []):
        found = {r.page_id: (r.rule, r.verdict) for r in urlrules.filter_urls(df, *listed_rules(spark, *chosen)).collect()}
        for k, u in enumerate(urls):
            host, path = u[7:].split("/", 1)
            host, path = host.translate(str.maketrans(urlrules.UPPER, urlrules.LOWER)), "/" + path
            fits = [(len(r), r, v) for v, r in chosen[0] if (host == (h := r.split("/", 1)[0]) or host.endswith("." + h)) and path.startswith("/" + r.split("/", 1)[1])]
            want = max(fits)[1:] if fits else (None, "block" if any(plain_pattern(p, host + path) for p in chosen[1]) else "allow")
            assert found[k] == want, (u, found[k], want)
    plan = urlrules.filter_urls(df.select("page_id", "url"), *listed_rules(spark))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_url_edges(spark):
    urls = [None, "", "no scheme", "http://", "HTTP://Sub.EXAMPLE.org/en/12?x", "http://example.org", "x://org/", "http://a.com/fr/casino-win", "http://casino-win.com/x", "http://notcasino-winx.com/", "http://user@example.org:80/es/", "http://a.org/\nb#c", "http://example.org/es/"]
    df = spark.createDataFrame([(k, u) for k, u in enumerate(urls)] + [(12, urls[12])], "page_id long, url string").withColumn("rule", F.lit("clash"))
    rows = urlrules.filter_urls(df, *listed_rules(spark)).collect()
    assert len(rows) == len(urls) + 1
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in rows}
    assert got[0] == got[1] == got[2] == ("", "", None, "allow") and got[3] == ("", "", None, "allow")
    assert got[4] == ("sub.example.org", "/en/12", "example.org/en/1", "block") and got[5] == ("example.org", "", None, "allow")
    assert got[6] == ("org", "/", "org/", "allow") and got[7][2:] == ("com/fr/", "allow")
    assert got[8][2:] == (None, "block") and got[9][2:] == (None, "allow") and got[12][2:] == ("example.org/es/", "block")
    assert urlrules.filter_urls(df.limit(0), *listed_rules(spark)).count() == 0


# 7 quality


def test_classifier_on_held_out_labels(spark, sf, odd):
    rows = queries.op7_subword_classifier(spark, "/root/testdata/sf0.01").collect()
    labels = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    held = [r for r in rows if r.held_out and r.doc_id in labels]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    assert np.mean([r.predicted == labels[r.doc_id] for r in held]) >= 0.95
    weights, bias = quality.train([quality.bag(b"good text"), quality.bag(b"%% bad %%")] * 10, np.array([1, 0] * 10))
    scored = quality.score_quality(odd, weights, bias).collect()
    assert len(scored) == odd.count() and all(r.score == r.score for r in scored)
    assert quality.score_quality(odd.limit(0), weights, bias).count() == 0


def test_long_texts_are_scored_like_one_block(monkeypatch):
    text = b" ".join(b"word%d" % k for k in range(3000))
    whole = quality.bag(text)
    monkeypatch.setattr(quality.blocks, "__defaults__", (1000,))
    parts = quality.bag(text)
    assert np.array_equal(whole[0], parts[0]) and np.allclose(whole[1], parts[1])


# 8 edit-aware counts


def test_edits_equal_a_full_count(monkeypatch):
    import public_tokenizers

    own = editcount.PieceCounter(queries.tokenizer_file("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    rng = random.Random(5)
    signs = "ab 's're ll1 2\n\n  ..!é \t"
    for _ in range(300):
        monkeypatch.setattr(editcount, "LEAF", rng.choice([2, 4, 64]))
        text = "".join(rng.choice(signs) for _ in range(rng.choice([0, 1, 5, 40, 400])))
        pieces = own.split(text)
        tree = editcount.PieceTree(text, [len(p) for p in pieces], own.counts(pieces))
        for _ in range(5):
            pos, cut, put = rng.randint(0, len(text) + 2), rng.choice([0, 1, 3, 30]), "".join(rng.choice(signs) for _ in range(rng.choice([0, 1, 10])))
            at = min(pos, len(text))
            text = text[:at] + put + text[at + cut :]
            tree.edit(own, pos, cut, put)
            assert tree.text == text and tree.n_tokens == sum(own.counts(own.split(text)))
    text = "word " * 20_000
    pieces = own.split(text)
    tree = editcount.PieceTree(text, [len(p) for p in pieces], own.counts(pieces))
    assert tree.edit(own, 50_000, 3, "new") <= 8


def test_edit_tables(spark, sf, odd):
    import public_tokenizers

    ranks, pattern = queries.tokenizer_file("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    own = editcount.PieceCounter(ranks, pattern)
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in queries.op8_edit_counts(spark, sf).collect():
        text = docs[r.doc_id] or ""
        n = len(text)
        for at, cut, put in ((n // 4, 7, " newly revised "), (n // 2, 0, "n't"), (n * 3 // 4, 12, "")):
            text = text[:at] + put + text[at + cut :]
        assert r.text_md5 == hashlib.md5(text.encode()).hexdigest()
        assert (r.tokens_before, r.tokens_after) == (sum(own.counts(own.split(docs[r.doc_id] or ""))), sum(own.counts(own.split(text))))
    state = editcount.build_state(odd, ranks, pattern)
    edits = spark.createDataFrame([(4, 2, 0, 1, "B"), (4, 1, 0, 0, "xyz "), (2, 1, 5, 5, None)], "id long, seq int, pos long, deleted long, inserted string")
    out = editcount.apply_edits(editcount.attach_edits(state, edits), ranks, pattern).collect()
    assert len(out) == odd.count() and {r.text for r in out if r.id == 4} == {"Byz same words here again and again"}
    assert editcount.build_state(odd.limit(0), ranks, pattern).count() == 0


# 9 decontamination


def test_leaks_are_found_and_clean_documents_left(spark, sf, odd):
    docs, items = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "benchmark"))
    texts, wanted = {r.doc_id: r.text for r in docs.collect()}, {r.item_id: r.text for r in items.collect()}
    truth = {(d, i) for d, t in texts.items() for i, x in wanted.items() if x in t}
    assert {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(docs, items).collect()} == truth
    more = spark.createDataFrame([(1, None), (2, ""), (None, "x"), (3, "same words here again"), (3, "a")], "item_id long, text string")
    found = decontaminate.find_leaks(odd, more).collect()
    assert {(r.doc_id, r.item_id) for r in found} == {(4, 3), (5, 3)} and len(found) == 3
    assert decontaminate.find_leaks(odd.limit(0), items).count() == 0 and decontaminate.find_leaks(odd, more.limit(0)).count() == 0


def test_block_max_wand_retrieves_all_above_the_threshold(monkeypatch):
    rng = random.Random(8)
    words = [f"w{k}" for k in range(60)]
    rows, texts = [], {}
    for item in range(80):
        own = [rng.choice(words) for _ in range(12)]
        weights = {w: rng.random() for w in set(own)}
        rows += [(item, 0, w, x / sum(weights.values())) for w, x in weights.items()]
        texts[item] = " ".join(own)
    monkeypatch.setattr(decontaminate, "BLOCK", 3)
    shard = decontaminate.Shard(rows, texts)
    for _ in range(50):
        query = set(rng.sample(words, 25))
        exact = {i: sum(x for item, _, w, x in rows if item == i and w in query) for i in range(80)}
        want = {i for i, s in exact.items() if s >= 0.5}
        assert {shard.item[s] for s, _ in shard.wand([shard.number[w.encode()] for w in query if w.encode() in shard.number], 0.5)} == want


# 10 WARC


def test_seekable_bundles(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "FRAME_BYTES", 500)
    monkeypatch.setattr(warc, "BUNDLE_BYTES", 900)
    rows = [(k, f"http://x/{k}\r\n", "".join(random.Random(k).choices("abcdef", k=300))) for k in range(30)] + [(50, None, None), (51, "u", ""), (52, "u", "é" * 10), (53, "u", "é" * 10), (None, "u", "é" * 10), (53, "u", "é" * 10)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("clash"))
    bundles = warc.write_bundles(df)
    names = warc.export_bundles(bundles, str(tmp_path))
    seen = 0
    for b in bundles.collect():
        for name, frame, offset in zip(b.record_ids, b.frames, b.offsets, strict=True):
            fields, _ = warc.read_record(b.archive, frame, offset)
            assert fields["WARC-Record-ID"] == name and {"WARC-Date", "Content-Type", "WARC-Type"} <= set(fields)
            seen += 1
    assert seen == len(rows) and len(names) > 1
    import zstandard

    data = open(names[0], "rb").read()
    whole = b"".join(zstandard.ZstdDecompressor().decompress(data[a : a + n]) for a, n in warc.frame_spans(data))
    assert zstandard.ZstdDecompressor().decompressobj(read_across_frames=True).decompress(data)[: len(whole)] == whole
    got = {(r.page_id, r.record_type, r.refers_to) for r in warc.archive_round_trip(df).collect() if r.page_id is None or r.page_id >= 50}
    assert got == {(50, "response", None), (51, "revisit", 50), (52, "response", None), (53, "revisit", 52), (None, "revisit", 52)}
    small = {r.page_id: r.record_type for r in warc.archive_round_trip(df, min_revisit_bytes=21).collect()}
    assert set(small.values()) == {"response"}
    assert warc.archive_round_trip(df.limit(0)).count() == 0
    first = bundles.first()
    info, rest = next(warc.parse_records(zstandard.ZstdDecompressor().decompress(first.archive[: warc.frame_spans(first.archive)[0][1]])))
    assert info["WARC-Type"] == "warcinfo" and rest.startswith(b"software: ")
    with pytest.raises(Exception, match="index says"):
        warc.read_bundles(bundles.withColumn("record_ids", F.reverse("record_ids"))).collect()
    fields, body = warc.read_record(first.archive, first.frames[0], first.offsets[0])
    wrong = warc.warc_record(1, b"u", b"other", fields["WARC-Payload-Digest"][5:], None, "2024-01-01T00:00:00Z")
    with pytest.raises(ValueError, match="digest"):
        warc.described(*next(warc.parse_records(wrong)))


# pipeline


def test_pipeline_against_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    docs = spark.createDataFrame(docs.collect(), docs.schema)
    texts = {r.doc_id: r.text for r in docs.collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    kept = stages.keep_quality(spark, docs, sf)
    assert kept.columns == docs.columns
    ids = {r.doc_id for r in kept.collect()}
    assert np.mean([(d in ids) == bool(q) for d, q in labels.items() if d in texts]) > 0.97
    single = stages.drop_near_duplicates(spark, docs, sf)
    want = exact_components(sorted(texts.items()), 5, 80)
    assert single.columns == docs.columns and sorted(r.doc_id for r in single.collect()) == sorted(d for d, (_, _, keep) in want.items() if keep)
    items = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    safe = stages.drop_leaks(spark, docs, sf)
    assert {r.doc_id for r in safe.collect()} == {d for d, t in texts.items() if not any(x in t for x in items)}
    masked = stages.mask_pii(spark, docs, sf)
    assert masked.columns == docs.columns
    for r in masked.collect():
        assert not personal.base_spans(r.text) or personal.base_spans(texts[r.doc_id])
        if not personal.base_spans(texts[r.doc_id]) and "[ID]" not in r.text:
            assert r.text == texts[r.doc_id]
    assert check_packed(sorted(texts.items()), stages.pack(spark, docs, sf).collect()) == 0


def test_pipeline_edges(spark, sf, odd):
    rows = odd.select("*", *[F.lit(k).alias(c) for k, c in enumerate(("row", "name", "label", "lm", "hash", "__group", "__id", "a.b", "text.x", "back`tick", "``"))])  # names that clash, or need quotes
    for name, stage in stages.STAGES[:-1]:
        assert stage(spark, rows, sf).columns == rows.columns, name
    texts = [f"{w} " * 3 + "and so on for a while" for w in ("one", "two")]
    two = spark.createDataFrame([(7, texts[0], None, None, 1), (7, texts[1], None, None, 2), (7, texts[0], None, None, 1), (None, texts[1], None, None, 3), (None, "", None, None, 4), (8, None, None, None, 5)], DOC)
    left = stages.drop_near_duplicates(spark, two, sf).collect()
    assert sorted(r.n_chars for r in left) == [1, 2, 4, 5]
    for name, stage in stages.STAGES:
        assert stage(spark, rows.limit(0), sf).count() == 0, name
        assert stage(spark, rows, sf).count() > 0, name
