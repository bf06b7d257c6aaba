"""Source divergence, personal data and token alignment against SQL, plain patterns and plain alignment."""

import hashlib
import random
import re
from collections import Counter

import public_tokenizers
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quillspan.llm import personal_data, queries, source_divergence, token_alignment
from quillspan.llm.common import settle, ship
from tests.conftest import DATA
from tests.llm.test_operators import DOCS, ODD, odd  # noqa: F401
from tests.oracle import assert_same, connect


def docs_of(spark, rows):
    return spark.createDataFrame(rows, DOCS)


def test_tries_keep_byte_order_and_merge():
    """Subtrees of any depth, packed and merged in any order and in steps, hold what a plain count holds."""
    rng = random.Random(3)
    say = lambda n: b" ".join("".join(rng.choice("abCé\U0001f600") for _ in range(rng.randint(1, 6))).encode() for _ in range(n))
    texts = [(f"s{k % 3}", say(rng.randint(0, 40))) for k in range(300)]
    docs, counts = Counter(), Counter()
    for source, text in texts:
        terms = re.findall(rb"[a-z\x80-\xff]+", text.lower())
        docs.update(set(terms))
        counts.update((t, source) for t in terms)
    for depth, merged, merged_node in ((1, 50, 20), (3, 10**6, 10**6), (9, 1, 1)):
        rows = []
        for k in range(0, 300, 60):
            tries = source_divergence.Counts()
            for source, text in texts[k : k + 60]:
                tries.count(source, text)
            nodes = list(tries.trie(depth))
            assert [n for n, _ in nodes] == sorted({n for n, _ in nodes})
            rows += [("x", node, *subtree.pack()) for node, subtree in nodes]
        rows.sort(key=lambda r: r[1])
        batches = [source_divergence._record_batch(source_divergence._SUBTREE, zip(*rows[k : k + 7])) for k in range(0, len(rows), 7)]
        got = [r for b in source_divergence._merge(2, merged, merged_node)(iter(batches)) for r in b.to_pylist()]
        assert {r["term"].encode(): r["docs"] for r in got} == {t: n for t, n in docs.items() if n >= 2} and len({r["term"] for r in got}) == len(got)
        assert {(r["term"].encode(), s): n for r in got for s, n in zip(r["sources"], r["counts"])} == {(t, s): n for (t, s), n in counts.items() if docs[t] >= 2}


def test_divergence_in_small_blocks_tiles_and_tries(spark):
    """Flushed tries, many ranges, blocks and tiles give what SQL gives."""
    ship(spark)
    want = connect(DATA).execute(source_divergence.ORACLE_SQL).df()
    docs = spark.read.parquet(f"{DATA}/documents.parquet").repartition(6)
    assert_same(source_divergence.divergence(docs, block=40, tile=3, leaves=500).toPandas(), want)


def test_divergence_by_hand(spark):
    """Groups without terms, null columns, languages without kept terms, ties and only A-Z lower-cased."""
    ship(spark)
    rows = [(i, "Aa bÉ", "en", "x", 0) for i in range(10)] + [(20, "aa aa 7", "en", "y", 0), (21, None, "en", "z", 0), (22, "rare", None, None, 0), (23, "rare", None, "w", 0)]
    got = source_divergence.divergence(docs_of(spark, rows)).collect()
    n, v = 22, 2  # aa: 10 + 2, bÉ: 10
    share = lambda c, whole: 1 + 10**9 * (c + 2) // whole
    count = {"x": (10, 10), "y": (2, 0), "z": (0, 0)}
    p = {s: [share(c, sum(cs) + 2 * v) for c in cs] for s, cs in count.items()} | {"": [share(12, n + 2 * v), share(10, n + 2 * v)]}
    f = lambda a, b: (a - b) ** 2 // (a + b)
    pairs = {(s, t): sum(f(a, b) for a, b in zip(p[s], p[t])) for s in count for t in count if s != t}
    assert {(r.source, r.item): r.value for r in got if r.part == "pair" and r.lang == "en"} == pairs
    terms = {(s, t): f(p[s][k], p[""][k]) for s in count for k, t in enumerate(("aa", "bÉ")) if count[s][k] and p[s][k] > p[""][k]}
    assert {(r.source, r.item): r.value for r in got if r.part == "term"} == terms
    assert {(r.source, r.item, r.value, r.rank) for r in got if r.lang == ""} == {("", "w", 0, 1), ("w", "", 0, 1)}


def test_shares_are_exact():
    import numpy as np

    rng = random.Random(5)
    wholes = [rng.randint(3, 9 * 10**15) for _ in range(300)]
    counts = [rng.randint(0, w - 2) for w in wholes]
    got = source_divergence._share(np.array(counts), np.array(wholes))
    assert got.tolist() == [1 + 10**9 * (c + 2) // w for c, w in zip(counts, wholes)]


def spans_by_patterns(text: str) -> list[tuple]:
    """The base kinds by their patterns as they are stated."""

    def passes_luhn(digits: str) -> bool:
        total = 0
        for i, c in enumerate(reversed(digits)):
            d = int(c) * (1 + i % 2)
            total += d - 9 if d > 9 else d
        return total % 10 == 0

    digits = lambda s: re.sub("[^0-9]", "", s)
    kinds = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(x) <= 255 for x in s.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda s: 14 <= len(digits(s)) <= 19 and passes_luhn(digits(s))), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 10 <= len(digits(s)) <= 15),
    ]
    found = [(kind, *m.span()) for kind, pattern, good in kinds for m in re.finditer(pattern, text) if good(m[0])]
    return sorted(found, key=lambda s: (s[1], personal_data.BASE.index(s[0])))


def test_personal_data_by_patterns(spark, odd):  # noqa: F811
    for folder in (DATA, odd):
        texts = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
        want = []
        for r in texts:
            spans = spans_by_patterns(r.text or "")
            digest = hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()
            want.append((r.doc_id or 0, *(sum(s[0] == k for s in spans) for k in personal_data.BASE), digest))
        got = queries.QUERIES["op12_personal_data"](spark, folder).collect()
        assert sorted((r.doc_id or 0, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in got) == sorted(want)
        for r in got:
            base = [s for s in r.spans.split(",") if s and s.split(":")[0] in personal_data.BASE]
            assert hashlib.sha256(",".join(base).encode()).hexdigest() == r.base_sha256


def test_personal_data_of_odd_characters():
    rng = random.Random(1)
    bits = ["a", "@", ".", "1", "22", "4", "0", " ", "-", "+", "(", ")", "é", "b.c", "255", "256", "4111111111111111", "%", "00007"]
    for _ in range(4000):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(1, 40)))
        assert [s[:3] for s in personal_data.spans_of(text) if s[0] in personal_data.BASE] == spans_by_patterns(text)


def test_personal_data_needs_checks_and_context(spark):
    of = lambda text: [(k, text[a:b]) for k, a, b, _ in personal_data.spans_of(text)]
    assert of("pay DE89 3704 0044 0532 0130 00 NOW") == [("iban", "DE89 3704 0044 0532 0130 00")]
    assert of("pay DE88 3704 0044 0532 0130 00 NOW") == []  # mod 97
    assert of("call (017) 555-7713 now") == [("national-phone", "(017) 555-7713")] and of("weighs (017) 555-7713 now") == []
    assert of("ssn 123-45-6789") == [("ssn", "123-45-6789")] and of("ssn 000-45-6789") == [] and of("order 123-45-6789") == []
    assert of("visa 4222222222222") == [("short-card", "4222222222222")] and of("sum 4222222222222") == []
    scores = {k: s for k, _, _, s in personal_data.spans_of("server 10.0.0.1") + personal_data.spans_of("version a@b.cd")}
    assert scores == {"ip": 0.9, "email": 0.6}
    assert personal_data.spans_of("1" * 200_000) == [] and len(personal_data.spans_of("a@b.c " * 20_000)) == 20_000
    ship(spark)
    rows = personal_data.masked(personal_data.find(docs_of(spark, [(1, "mail é.x@y.zz or +1 (017) 555-7713!", None, None, 0), (2, None, None, None, 0), (3, "", None, None, 0)])))
    assert {r.doc_id: r.masked for r in rows.collect()} == {1: "mail é[email] or [phone]!", 2: None, 3: ""}


def alignment_by_hand(texts: list[str | None]) -> list[tuple]:
    """n_a, n_b, n_groups, n_links, n_best, count_sum, digest of each text by two walks along the tokens."""
    a_kit = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a_kit.encode_special_tokens = True
    b_kit = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    alphabet = token_alignment._byte_alphabet()
    found = []
    for text in texts:
        a = a_kit.encode(" " + text, add_special_tokens=False).ids if text else []
        b = b_kit.encode(text) if text else []
        a_raw = [bytes(alphabet[c] for c in a_kit.id_to_token(i)) for i in a]
        b_raw = [bytes([int(b_kit.id_to_piece(i)[3:5], 16)]) if b_kit.is_byte(i) else b_kit.id_to_piece(i).replace("▁", " ").encode() for i in b]
        if not text or not b"".join(a_raw) == b"".join(b_raw) == (" " + text).encode():
            found.append(None)
            continue
        links, groups, own, i, j, end_a, end_b = [], [], ([a[0]], [b[0]]), 0, 0, len(a_raw[0]), len(b_raw[0])
        while True:
            links.append((a[i], b[j]))
            go_a, go_b = end_a <= end_b, end_b <= end_a
            if go_a and go_b:
                groups.append("|".join(",".join(map(str, x)) for x in own))
                own = ([], [])
            i, j = i + go_a, j + go_b
            if i == len(a):
                break
            if go_a:
                end_a += len(a_raw[i])
                own[0].append(a[i])
            if go_b:
                end_b += len(b_raw[j])
                own[1].append(b[j])
        found.append((len(a), len(b), groups, links))
    held = Counter(link for x in found if x for link in set(x[3]))
    most: dict[int, int] = {}
    for (a, _), n in held.items():
        most[a] = max(n, most.get(a, 0))
    return [
        (0, 0, 0, 0, 0, 0, "") if x is None else
        (x[0], x[1], len(x[2]), len(x[3]), sum(held[k] == most[k[0]] for k in x[3]), sum(held[k] for k in x[3]), hashlib.sha256(";".join(x[2]).encode()).hexdigest()) for x in found
    ]


NUMBERS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def test_alignment_by_two_walks(spark, odd):  # noqa: F811
    for folder in (DATA, odd):
        rows = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
        want = sorted((r.doc_id or 0, *x) for r, x in zip(rows, alignment_by_hand([r.text for r in rows])))
        got = queries.QUERIES["op13_token_alignment"](spark, folder).collect()
        assert sorted((r.doc_id or 0, *(r[c] for c in NUMBERS)) for r in got) == want


def test_alignment_of_odd_texts_and_rare_pairs(spark):
    """White space, control characters, U+2581, special tokens as text, and pairs beyond the broadcast."""
    texts = [
        " ", "  ", "a  b", "a \n b\t\r\n c ", "x▁y", "▁", "<|endoftext|> <s> <unk> <0x0A>", "it's   I'll  ", "naïve 日本語 \U0001f600\U0001f600", "  a　 b", "a\x00b \x1c c", "é ﬁ ①", "0" * 300, "\n\n\n", "()\r\n{\r",
        "word " * 50, "word " * 50, None, "", " leading", "trailing ", "\x1c x", "a\u0085 b",
    ]
    ship(spark)
    docs = docs_of(spark, [(i, t, None, None, 0) for i, t in enumerate(texts)])
    files = token_alignment.load_files(spark, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    want = [x[:6] for x in alignment_by_hand(texts)]
    rows = settle(token_alignment.aligned(docs, files).withColumn("row", F.monotonically_increasing_id()), "test-aligned")
    for frequent in (1 << 18, 20):
        got = {r.id: tuple(r[c] for c in NUMBERS[:6]) for r in token_alignment.with_corpus_counts(rows, frequent).collect()}
        assert [got[i] for i in range(len(texts))] == want
