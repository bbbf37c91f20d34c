"""The training-data operators against brute-force versions, and on awkward inputs."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from sparcase.llm import bpe_automaton, components, exact_dedup, html_text, near_dedup, packing, pii, quality_model, quality_rules, secret_scan, token_counts, wordpieces

SF = "/root/testdata/sf0.001"
ODD = [None, "", " ", "\n\n", "a", "one two", "the end. " * 3, "x" * 50_000, "word " * 20_000, "9" * 30_000, "日本語 テキスト é \x1c\x85", "<|endoftext|> and <|startoftext|>", "Σίσυφος İstanbul", "😀 a@b.co 😀", "one two", "one two"]
SCHEMA = "doc_id long, text string, node string, key string, bands string, sequence_id int"


def odd(spark):
    """Awkward texts, repeated rows, null ids, and columns whose names the operators use themselves."""
    rows = [(i, t, "n", "k", "b", 7) for i, t in enumerate(ODD)] + [(14, "one two", "n", "k", "b", 7), (None, "null id", None, None, None, None), (None, None, "n", "k", "b", 7)]
    return spark.createDataFrame(rows, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def texts(spark):
    return {r["doc_id"]: r["text"] for r in docs(spark).collect()}


@pytest.fixture(scope="module")
def word_library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(wordpieces.default_path())


def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")


OPERATORS = {
    "exact": exact_dedup.exact_dedup,
    "near": near_dedup.near_dedup,
    "pack": packing.pack,
    "count": token_counts.token_counts,
    "rules": quality_rules.quality_rules,
    "secrets": secret_scan.secret_scan,
    "round_trip": bpe_automaton.round_trip,
    "pii": pii.pii,
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_awkward_rows(spark, name):
    rows = odd(spark)
    out = OPERATORS[name](rows).collect()
    assert len(out) >= rows.count() if name == "pack" else len(out) == rows.count()
    assert OPERATORS[name](empty(spark)).count() == 0


def test_exact_dedup(spark):
    rows = odd(spark)
    groups = {}
    for r in rows.collect():
        groups.setdefault(r["text"] or "", []).append(r["doc_id"])
    top = lambda ids: max((i for i in ids if i is not None), default=None)
    kept = 0
    for r in exact_dedup.exact_dedup(rows).collect():
        text = next(t for t in groups if hashlib.sha256(t.encode()).hexdigest() == r["text_sha256"])
        assert (r["keep_id"], r["group_size"]) == (top(groups[text]), len(groups[text]))
        kept += r["kept"]
    assert kept == len(groups)
    assert sorted((r["text"] or "") for r in exact_dedup.keep_one(rows).collect()) == sorted(groups)


@pytest.mark.parametrize("keep", [exact_dedup.keep_one, near_dedup.keep_one])
def test_rows_kept_whole(spark, keep):
    """Columns of any names, those that the operators use themselves and ones with dots among them, come along as they are."""
    kinds = "doc_id long, text string, _text string, _maybe int, _h int, _id string, row string, kept boolean, text_id string, `a.b` string, class_id long"
    rows = [(i, t, f"t{i}", i, i, f"i{i}", "r", False, "x", f"ab{i}", 9) for i, t in ((1, "one two"), (2, "one two"), (3, None), (4, ""), (5, "other"))]
    out = keep(spark.createDataFrame(rows, kinds))
    assert out.columns == [c.strip("`") for c in (k.split(" ")[0] for k in kinds.split(", "))]
    want = {2, 4, 5} if keep is exact_dedup.keep_one else {1, 3, 5}
    assert sorted(map(tuple, out.collect())) == [r for r in rows if r[0] in want]


def test_chunks_follow_content():
    rng = random.Random(1)
    passage = bytes(rng.randrange(97, 123) for _ in range(30_000))
    a, b = exact_dedup.recipe(passage), exact_dedup.recipe(b"new start " + passage)
    assert len({c["digest"] for c in a} & {c["digest"] for c in b}) >= len(a) - 3
    assert sum(c["size"] for c in a) == len(passage) and exact_dedup.recipe(b"") == []


def test_components(spark):
    rng = random.Random(5)
    links = [(f"n{rng.randrange(80):03}", f"n{rng.randrange(80):03}") for _ in range(60)] + [(f"p{i:03}", f"p{i + 1:03}") for i in range(40)] + [("hub", f"s{i:03}") for i in range(50)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        if a != b:
            parent[max(find(a), find(b))] = min(find(a), find(b))
    got = {r["node"]: r["comp"] for r in components.components(spark.createDataFrame(links, "a string, b string")).collect()}
    assert got == {x: find(x) for x in list(parent)}


def test_components_of_odd_links(spark):
    links = [(None, "a"), ("a", None), (None, None), ("a", "a"), ("b", "c"), ("c", "b"), ("b", "c")]
    got = components.components(spark.createDataFrame(links, "a string, b string")).collect()
    assert sorted(map(tuple, got)) == [("b", "b"), ("c", "b")]
    assert components.components(spark.createDataFrame([], "a string, b string")).count() == 0


def copies(spark):
    """Distinct texts, near copies with few words changed, a large group, and rows that only share a passage."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    rows, passage = [], [word() for _ in range(60)]
    for i in range(30):
        base = [word() for _ in range(150)]
        rows.append((i * 100, " ".join(base)))
        for j in range(3):
            edit = list(base)
            edit[rng.randrange(150)] = word()
            rows.append((i * 100 + j + 1, " ".join(edit)))
    base = [word() for _ in range(150)]
    for i in range(150):
        edit = list(base)
        for _ in range(rng.randrange(12)):
            edit[rng.randrange(150)] = word()
        rows.append((10_000 + i, " ".join(edit)))
    rows += [(20_000 + i, " ".join(passage + [word() for _ in range(120)])) for i in range(80)]
    return spark.createDataFrame(rows, "doc_id long, text string")


@pytest.mark.parametrize("make, block", [(copies, 512), (copies, 8), (docs, 512)])
def test_near_dedup(spark, make, block, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    rows = make(spark)
    weights, shingles = near_dedup.shingle_weights(rows), near_dedup.Shingler()
    found = {r["doc_id"]: near_dedup.weighted(r["text"], shingles, weights) for r in rows.collect()}
    parent = {i: i for i in found}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(found)
    text = {r["doc_id"]: r["text"] for r in rows.collect()}
    for n, a in enumerate(ids):
        for b in ids[:n]:
            if text[a] == text[b] or (len(np.intersect1d(found[a][0], found[b][0])) and near_dedup.jaccard(found[a], found[b]) >= 0.8):
                parent[max(find(a), find(b))] = min(find(a), find(b))
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.near_dedup(rows).collect()}
    assert got == {i: find(i) for i in ids}


def test_a_stranger_in_a_hot_bucket(spark):
    """The rows compared grow with the bucket, not with its square, and no two texts of the largest class meet."""
    rows = [(7, 0, f"n{i:05}", "top", 20_003, "top", 3) for i in range(20_000)] + [(7, 0, f"x{i}", f"x{i}", 20_003, "top", 3) for i in range(3)]
    dealt = near_dedup._deal(spark.createDataFrame(rows, "key long, band int, node string, comp string, n long, top string, rest long"))
    n = dealt.count()
    assert n == 20_000 + 3 * (1 + 40)
    meets = {(r["i"], r["j"]) for r in dealt.where("comp <> 'top'").select("i", "j").distinct().collect()}
    assert meets == {(0, j) for j in range(41)} and dealt.where("comp = 'top' and i > 0").count() == 0


def test_links_across_classes():
    """Verified links join classes that have one; texts of one class aren't compared."""
    rng = random.Random(12)
    base = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(200)]
    flat, shingles = np.zeros(1 << near_dedup.FREQUENCY_BITS, dtype=np.float32), near_dedup.Shingler()
    rows = []
    for i in range(120):
        edit = list(base)
        for _ in range(rng.randrange(6)):
            edit[rng.randrange(200)] = "x" + str(rng.random())
        features = near_dedup.weighted(" ".join(edit), shingles, flat)
        drawn = near_dedup.sample([features])
        rows.append((0, b"%03d" % i, b"c%d" % (i % 3), (drawn[0] >> np.uint64(48)).astype("<u2").tobytes(), near_dedup.bands(drawn)[0].tobytes(), " ".join(edit)))
    for some in (rows, rows[:9]):
        links = list(near_dedup._block_links(some, 0, flat, 0.8))
        comp = {r[1]: r[2] for r in some}
        assert len(links) == 2 and len({frozenset((comp[a], comp[b])) for a, b in links}) == 2


def test_frequencies_keep_their_contrast():
    """A rare shingle weighs about the same whatever load others bring to its entry; a frequent one weighs less."""
    rng = np.random.default_rng(3)
    for load, n in ((0, 10**4), (60, 10**6), (286_000, 10**9)):
        df = rng.poisson(load, 1 << 16)
        df[:100] += n // 20
        w = np.exp(near_dedup.log_weights_of(df, n))
        assert (w[100:] > 0.97).mean() > 0.99 and (w[:100] < 0.8).all()


def test_long_texts_agree_as_often():
    rng = np.random.default_rng(8)
    for n in (300, 3_000, 20_000):
        keys = np.sort(rng.integers(0, 1 << 63, n + n // 9, dtype=np.uint64) * np.uint64(2) + np.uint64(1))
        flat = np.zeros(n, dtype=np.float32)
        a, b = (keys[:n], flat), (keys[n // 9 :], flat)
        drawn = near_dedup.sample([a, b], 2000, 14, 5)
        assert abs((drawn[0] == drawn[1]).mean() - near_dedup.jaccard(a, b)) < 0.03, n


def test_weighted_sampling():
    """Samples agree as often as the weighted Jaccard similarity says."""
    rng = np.random.default_rng(2)
    keys = np.sort(rng.integers(0, 1 << 63, 400, dtype=np.uint64))
    a, b = (keys[:300], np.log(rng.uniform(0.5, 3, 300)).astype(np.float32)), None
    w = np.concatenate([a[1][100:], np.log(rng.uniform(0.5, 3, 100)).astype(np.float32)])
    b = (keys[100:], w)
    drawn = near_dedup.sample([a, b], 2000, 12, 5)
    assert abs((drawn[0] == drawn[1]).mean() - near_dedup.jaccard(a, b)) < 0.05


def test_pack(spark, word_library):
    rows = docs(spark).unionByName(odd(spark).selectExpr("doc_id + 1000000 as doc_id", "text"), allowMissingColumns=True).where("doc_id is not null")
    text = [(r["doc_id"], r["text"] or "") for r in rows.select("doc_id", "text").collect()]
    ids = {}
    for i, t in text:
        ids.setdefault(i, word_library.encode(t, add_special_tokens=False).ids + [2])
    pieces, sequences = {}, {}
    for r in packing.pack(rows).collect():
        own = np.array(ids[r["doc_id"]][r["start"] : r["start"] + r["length"]], "<u4").tobytes()
        assert r["doc_tokens"] == len(ids[r["doc_id"]]) and r["ids_crc32"] == zlib.crc32(own)
        pieces.setdefault(r["doc_id"], []).append((r["start"], r["length"]))
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    count = {}
    for i, _ in text:
        count[i] = count.get(i, 0) + 1
    for i, p in pieces.items():
        assert sum(n for _, n in p) == len(ids[i]) * count[i]
    for p in sequences.values():
        at = 0
        for o, n in sorted(p):
            assert o == at
            at += n
        assert at == 4096 or at & (at - 1) == 0
    assert set(pieces) == set(ids)


def test_packer_balances():
    p = packing.Packer(100, 1.0, 0.01)
    rng = random.Random(3)
    sizes = [rng.randrange(1, 60) for _ in range(300)]
    for k, n in enumerate(sizes):
        p.add(k, n)
    cost, used = {}, {}
    for _, _, n, q, _ in p.flush():
        cost[q] = cost.get(q, 0) + p.cost(n)
        used[q] = used.get(q, 0) + n
    assert set(used.values()) == {100} and len(used) == sum(sizes) // 100
    spread = np.array(list(cost.values()))
    assert spread.std() / spread.mean() < 0.2


def test_packer_takes_whole():
    """A piece goes to the sequence of lowest cost that can take it whole, as if all sequences were tried."""
    rng = random.Random(4)
    for _ in range(30):
        sizes = [rng.randrange(1, 100) for _ in range(rng.randrange(5, 120))]
        p, many = packing.Packer(100, 1.0, 0.01), sum(sizes) // 100
        for k, n in enumerate(sizes):
            p.add(k, n)
        cost, room, want = [0.0] * many, [100] * many, []
        for k, n in sorted(enumerate(sizes), key=lambda x: (-x[1], x[0])):
            start = 0
            while n and any(room):
                fits = [i for i in range(many) if room[i] >= n] or [i for i in range(many) if room[i]]
                i = min(fits, key=lambda i: (cost[i], i))
                take = min(n, room[i])
                want.append((k, start, take, i, 100 - room[i]))
                cost[i], room[i], start, n = cost[i] + p.cost(take), room[i] - take, start + take, n - take
        assert list(p.flush()) == want


def test_token_counts(spark, texts, word_library):
    for r in token_counts.token_counts(docs(spark)).collect():
        t = texts[r["doc_id"]]
        n = len(word_library.encode(t, add_special_tokens=False).ids)
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(t.encode()), n, n > 2048)
    for r in token_counts.token_counts(odd(spark).where("doc_id is not null")).collect():
        assert r["n_tokens"] == len(word_library.encode(ODD[r["doc_id"]] or "", add_special_tokens=False).ids)


def test_any_text_by_pre_tokens(word_library, monkeypatch):
    """Texts of any script are counted and encoded by pre-tokens: the library never sees one whole."""
    rng = random.Random(5)
    bits = ["a", "Word", "’s", "“x”", "—", "é", "e\u0301", "ﬁ", "İ", "ß", "漢字", "क्षि", "😀", "٣", "½", " ", "\u00a0", "\u2003", "\n", "'ll", "12", "<|endoftext|>", "<|startoftext|>", "<|", "|>", "\x85", "\x1c", "\ufeff", "Ω"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(60))) for _ in range(500)]
    want = [word_library.encode(t, add_special_tokens=False).ids for t in texts]
    known = wordpieces.word_pieces(wordpieces.default_path())
    monkeypatch.setattr(known, "encode", lambda text: pytest.fail("whole text"))
    assert [np.frombuffer(x, "<u4").tolist() for x in wordpieces.encode_texts(texts, wordpieces.default_path())] == want
    assert token_counts.count_block(texts, wordpieces.default_path()).tolist() == list(map(len, want))


def test_bpe(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(bpe_automaton.default_path())
    known = bpe_automaton.automaton(bpe_automaton.default_path())
    rng = random.Random(2)
    some = [t or "" for t in ODD] + ["".join(rng.choice("aaab the'sll 12.!é😀\n") for _ in range(80)) for _ in range(200)]
    for t, ids in zip(some, known.encode(some)):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode(t, add_special_tokens=False).ids
        assert known.decode(ids).decode() == library.decode(np.frombuffer(ids, "<u4").tolist(), skip_special_tokens=False)
    rows = docs(spark)
    back = bpe_automaton.decode(bpe_automaton.encode(rows)).withColumnRenamed("text", "back").join(rows, "doc_id")
    assert back.where("back <> text").count() == 0


def test_automaton_small():
    """Merges applied by hand: lowest first, from the left."""
    vocab = {c: i for i, c in enumerate(["a", "b", "c", "aa", "ab", "aab", "bc"])}
    machine = bpe_automaton.Automaton(vocab, [("a", "a"), ("a", "b"), ("aa", "b"), ("b", "c")])

    def slow(word):
        parts = list(word)
        for x, y in [("a", "a"), ("a", "b"), ("aa", "b"), ("b", "c")]:
            out, i = [], 0
            while i < len(parts):
                if parts[i : i + 2] == [x, y]:
                    out.append(x + y)
                    i += 2
                else:
                    out.append(parts[i])
                    i += 1
            parts = out
        return [vocab[p] for p in parts]

    rng = random.Random(9)
    for _ in range(500):
        w = "".join(rng.choice("abc") for _ in range(rng.randrange(1, 12)))
        assert machine.encode_word(w.encode()) == slow(w)


def test_quality_model(spark):
    rows = quality_model.quality_scores(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet"))
    truth = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    out = rows.join(truth, "doc_id").where("held_out").toPandas()
    assert len(out) > 50 and ((out["predicted"] == out["quality"]).mean() > 0.97)
    every = rows.toPandas()
    assert len(every) == 1000 and every["score"].between(0, 1).all()
    assert all(h == (zlib.crc32(str(i).encode()) % 4 == 2) for i, h in zip(every["doc_id"], every["held_out"]))


def test_quality_model_awkward(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality_model.quality_scores(odd(spark), none).count() == odd(spark).count()
    assert quality_model.quality_scores(empty(spark), labels(spark)).count() == 0
    assert quality_model.quality_scores(odd(spark), labels(spark)).where("score is null or score < 0 or score > 1").count() == 0


def slow_rules(text):
    words = [w for w in re.split("[\x20\x09-\x0d]+", text) if w]
    windows = {}
    for i in range(len(words) - 7):
        windows.setdefault(tuple(words[i : i + 8]), []).append(i)
    covered = {i + k for places in windows.values() if len(places) > 1 for i in places for k in range(8)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search("[^\x20\x09-\x0d]", line):
            dup += line in seen
            seen.add(line)
    failed = len(words) < 20 or 100 * len(covered) > 30 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered), failed


def test_quality_rules(texts):
    for t in [*texts.values(), *[t or "" for t in ODD], "a b c d e f g h " * 3, "x\x85y z " * 30]:
        assert quality_rules.judge(t)[:6] == slow_rules(t)
    assert quality_rules.line_fails("Home | News | Contact", ["Home", "|", "News", "|", "Contact"])
    assert quality_rules.line_fails("A plain sentence about nothing.", "A plain sentence about nothing.".split()) is None


LINES = [
    ("Home | News | Contact", False), ("Read more", False), ("Cliquez ici pour lire la suite de cet article.", False), ("Alle Rechte vorbehalten, 2024 Verlag.", False), ("Todos los derechos reservados por la empresa.", False), ("Datenschutzerklärung und Impressum.", False),
    ("Buy now!! Hurry!! Today!!", False), ("# * $ % & |", False), ("so so so so so so it went on.", False), ("one two three", False),
    ("The house by the sea was sold last year to a painter.", True), ("La maison au bord de la mer a été vendue.", True), ("Das Haus am Meer wurde im letzten Jahr verkauft.", True), ("La casa junto al mar se vendió el año pasado.", True), ("We met.", True),
    ("a line of more than three words without a closing mark", True), ("very very very very good", True), ("It cost 5% more.", True), ("", True), (" \t ", True),
]


def slow_verdict(text):
    """kept, lines, lines removed, characters lost and the text left, each line judged by the table above."""
    verdict = dict(LINES)
    lines = text.split("\n")
    own = [x for x in lines if x.strip(" \t\n\x0b\x0c\r")]
    gone = [x for x in own if not verdict[x]]
    size = lambda xs: sum(len(w) for x in xs for w in re.split("[\x20\x09-\x0d]+", x))
    failed = slow_rules(text)[5]
    return not failed and 2 * size(gone) <= size(own), len(own), len(gone), size(gone), "\n".join(x for x in lines if verdict[x])


def test_quality_rules_of_whole_query(spark):
    rng = random.Random(13)
    texts = ["\n".join(rng.choice(LINES)[0] for _ in range(rng.randrange(1, 14))) for _ in range(300)]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in quality_rules.quality_rules(rows).collect()}
    kept = 0
    for i, t in enumerate(texts):
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == slow_rules(t)
        assert (r["kept"], r["n_lines"], r["n_removed_lines"], r["removed_chars"], r["clean_text"]) == slow_verdict(t), t
        kept += r["kept"]
    assert 20 < kept < 280


PAGE = """<html><head><title>t</title><style>p{}</style><script>var a = "</p>";</script></head><body><header><h1>Site</h1></header><nav><ul><li>Menu</ul></nav><div class="cookie-notice">Cookies!</div>
<article><header><h1>Head&nbsp;line</h1></header><p>One &amp; two<br>three <b>bold<p>Next   para&#233;</p><aside>side</aside><div class="ad">Buy</div><form>f</form><!-- <p>no</p> --><ul><li>item</ul><section id="comments"><p>nice</p></section></article><footer>foot</footer></body>"""


def test_html_structure():
    assert html_text.page_blocks(PAGE)[0] == ["Head line", "One & two", "three bold", "Next paraé", "item"]
    assert html_text.page_blocks("")[1] == [] and html_text.page_blocks("<p>a<p>b")[1] == ["a", "b"]
    assert html_text.page_blocks("1 < 2 <b>x</b>")[1] == ["1 < 2 x"]


def test_html_suffix_array(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    shared = [word() for _ in range(25)]
    own = [[word() for _ in range(40)] for _ in range(6)]
    rows = [(i, f"http://h.example/{i}", f"<p>{' '.join(shared)}</p><p>{' '.join(w)}</p>") for i, w in enumerate(own)] + [(9, None, None), (10, "http://h.example/x", PAGE), (None, "u", "<p>z</p>")]
    out = {r["page_id"]: r for r in html_text.html_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert len(out) == 9 and all(out[i]["text"] == " ".join(w) for i, w in enumerate(own))
    assert out[9]["text"] == "" and out[10]["text"].startswith("Head line") and out[10]["n_chars"] == len(out[10]["text"])
    streams = [[rng.choice("ab") for _ in range(30)] for _ in range(5)]
    for i, got in enumerate(html_text.repeated(streams, 5, 2)):
        grams = [{tuple(s[k : k + 5]) for k in range(len(s) - 4)} for s in streams]
        want = np.zeros(30, dtype=bool)
        for k in range(26):
            if sum(tuple(streams[i][k : k + 5]) in g for g in grams) >= 2:
                want[k : k + 5] = True
        assert (got == want).all()


def slow_secrets(t):
    out = [("assign", *m.span()) for m in re.finditer(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t) if len(m[2]) >= 8]
    out += [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 16]
    return out + [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 32]


def test_secrets(spark, texts):
    rng = random.Random(6)
    bits = ["AKIA", "ABCDEF123456", "token", "Secret", '"', " ", "=", ":", "a1b2c3d4" * 4, "x_y.z", "paſſword", "\n", "api_key", "😀", "deadbeef"]
    some = [*texts.values(), *["".join(rng.choice(bits) for _ in range(rng.randrange(30))) for _ in range(400)]]
    for t in some:
        assert sorted(secret_scan.base_spans(t)) == sorted(slow_secrets(t))
    text = "client_id=acme-app-01 then key Zx81kQp7Lm2Vt9Rw4Ys6 done"
    kinds = [k for k, *_ in secret_scan.linked_spans(text, secret_scan.base_spans(text))]
    assert sorted(kinds) == ["weak_access", "weak_secret"]
    assert secret_scan.linked_spans("a key Zx81kQp7Lm2Vt9Rw4Ys6 alone", []) == []
    far = text[:22] + " " * 500 + text[22:]
    assert secret_scan.linked_spans(far, []) == [] and secret_scan.linked_spans(text[:22] + "\n\n" + text[22:], []) == []
    many = 'token="' + ".".join(f"AKIA{'ABCDEFGHIJK'[:11]}{i}" for i in range(1, 9)) + '.Zx81kQp7Lm2Vt9Rw4Ys6Xa12"'
    base = secret_scan.base_spans(many)
    assert len(base) == 9 and secret_scan.linked_spans(many, base) == []  # all lies in the first span
    rows = spark.createDataFrame([(1, "token = abcdefgh12", "x"), (2, None, "y")], "doc_id long, text string, other string")
    assert [(r["text"], r["other"]) for r in secret_scan.redact_documents(rows).orderBy("doc_id").collect()] == [("[SECRET]", "x"), (None, "y")]


def luhn(s):
    return sum(d if not i % 2 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(map(int, reversed(s)))) % 10 == 0


def slow_pii(t):
    digits = lambda s: re.sub("[^0-9]", "", s)
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 16 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 8 <= len(digits(m[0])) <= 15]


def test_pii(spark, texts):
    rng = random.Random(8)
    bits = ["a", "b1", "@", "@x.com", ".", "-", "+", "1", "23", "4111111111111111", "4111 1111 1111 1111", " ", "(", "255", "256.1.2.3", "1.2.3.4", "😀", "\n", "+49 (30) 123-4567 89", "a@b.c_d@e.f", "%"]
    some = dict(texts) | {10**6 + i: "".join(rng.choice(bits) for _ in range(rng.randrange(1, 40))) for i in range(600)}
    rows = spark.createDataFrame([*some.items(), (5 * 10**6, "reach me by e-mail: jane.doe (at) example (dot) com or tel 212-555-0143 and do not ever mention to anybody the order 112-555-0199")], "doc_id long, text string")
    for r in pii.pii(rows).collect():
        if r["doc_id"] == 5 * 10**6:
            assert "hidden_email" in r["spans"] and r["spans"].count("local_phone") == 1
            continue
        want = ",".join(f"{k}:{a}:{b}" for k, a, b in slow_pii(some[r["doc_id"]]))
        assert r["base_sha256"] == hashlib.sha256(want.encode()).hexdigest()
        assert set(want.split(",")) <= set(r["spans"].split(","))


def test_classifier_follows_the_data():
    """Labelers that the data contradict lose their say, ones that agree keep it; few candidates leave the priors."""
    weak, strong = pii.KINDS.index("name"), pii.KINDS.index("email")
    said = {v: n for v, n in (((0, 1, 1, 0), 4000), ((0, 0, 0, -1), 4000), ((0, 0, 0, 0), 2000))}
    model = pii.estimate([(weak, v, n) for v, n in said.items()] + [(strong, (1, 1, 1, 0), 50)])
    score = lambda m, k, vote: 1 / (1 + np.exp(-(m.bias + m.kinds[k] + sum(m.weights[j, v] for j, v in enumerate(vote) if v))))
    assert score(model, weak, (0, 1, 1, 0)) > 0.9 and score(model, weak, (0, 0, 0, -1)) < 0.1 and score(model, strong, (1, 1, 1, 0)) > 0.9
    none = pii.estimate([])
    assert score(none, weak, (0, 1, 1, 0)) > 0.8 and score(none, weak, (0, 0, 0, 0)) < 0.5


def test_many_matches(spark):
    """Places are right beyond a run of matches, and a hundred thousand of them are no matter of minutes."""
    text = " ".join(f"u{i}@x{i % 7}.com" + "é" * (i % 3) for i in range(100_000))
    rows = spark.createDataFrame([(1, text), (2, " ".join(["a@b.co"] * 513)), (3, "")], "doc_id long, text string")
    got = {r["doc_id"]: r["m"] for r in rows.select("doc_id", pii.matches(rows["text"], pii.EMAIL).alias("m")).collect()}
    for i, t in ((1, text), (2, " ".join(["a@b.co"] * 513)), (3, "")):
        assert [(x["start"], x["end"], x["value"]) for x in got[i]] == [(*m.span(), m[0]) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]


def test_pii_is_native(spark):
    plan = pii.candidates(docs(spark).select("doc_id", "text"))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
