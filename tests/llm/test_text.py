import random
from collections import Counter, defaultdict

import pyarrow as pa
import pytest

from vecledger.llm import leaks, textstats, tokens
from vecledger.llm.textstats import statistics, text_statistics, text_types
from vecledger.llm.topn import top_n

TEXTS = [
    None, "", " ", "\n\n", "plain words", "it's we'll don't 'tis", "a  b   c\n\n\n d\t\te \n", "<|endoftext|> is text", "x" * 9000, "東京都は日本の首都です。" * 700,
    "naïve café — “quoted” ☃ 🏳️‍🌈 ​­", "tab\there  　wide nbsp  em", "12345 6,789.00 3.14", "word " * 3000, "ab'" + "re " * 2 + "'r" + "e",
] + [" ".join(random.Random(i).choices(["the", "Ærø", "don't", "  ", "\n", "x9", "…", "ξένος", "'ll", "日本"], k=400)) for i in range(20)]


@pytest.mark.parametrize(("mask", "long"), [(tokens.MASK, tokens.LONG), (0, 4096), (0xFFFF, 48), (3, 16)])
def test_tokens_agree_with_plain_encoding(mask, long, monkeypatch):
    monkeypatch.setattr(tokens, "LONG_MASK", 15)
    monkeypatch.setattr(tokens, "LONG", long)
    plain = [None if t is None else tokens.encoder(tokens.VOCABULARY).encode_ordinary(t) for t in TEXTS]
    got = tokens.encode_texts(pa.array(TEXTS), cache=[{}, {}], mask=mask, long=long).to_pylist()
    assert [g for g, t in zip(got, TEXTS, strict=True) if t is not None] == [p for p in plain if p is not None]


def test_tokens_query(spark):
    rows = [(i, t, t) for i, t in enumerate(TEXTS)] + [(0, None, "x"), (None, "a", "x")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids string").repartition(3)
    got = tokens.token_ids(df, "doc_id", "text")
    assert got.dtypes == [("doc_id", "bigint"), ("ids", "array<int>")]
    by = {r[0]: r[1] for r in got.collect()}
    plain = tokens.encoder(tokens.VOCABULARY).encode_ordinary
    assert by[0] is None and by[1] == [] and by[None] == plain("a")
    assert all(by[i] == plain(t) for i, t in enumerate(TEXTS) if t)
    assert tokens.token_ids(df.where("false"), "doc_id", "text").count() == 0


def test_chunks_are_shared():
    menu = "\nHome | News | Contact us | Sign up for the newsletter | Terms and conditions | Print this page | Share with friends"
    cache = [{}, {}]
    tokens.encode_texts(pa.array(["first page says this and that" + menu]), cache=cache)
    known = len(cache[0])
    tokens.encode_texts(pa.array(["another page with other words" + menu]), cache=cache)
    assert len(cache[0]) - known <= 2


ITEM = "Suppose that every porous isotope halves exactly 16 hectares of turbine before its pressure becomes equal to the temperature of the circuit"
SCHEMA = "doc_id bigint, body string, item_id string"


def test_words_as_seen():
    assert leaks.words_of("Café CAFÉ ＣＡＦＥ ca­f​e &eacute;t&#233; a&nbsp;b x²_y Straße") == ["cafe", "cafe", "cafe", "cafe", "ete", "a", "b", "x2", "y", "strasse"]
    assert leaks.words_of(None) == leaks.words_of("") == leaks.words_of(" . ") == []


def test_leaks_against_brute_force(spark):
    rng = random.Random(2)
    vocabulary = [f"w{i}" for i in range(40)]
    items = [(1, ITEM), (2, "intro words here " + ITEM), (3, "too short"), (4, None), (5, "")] + [(10 + i, " ".join(rng.choices(vocabulary, k=30))) for i in range(30)] + [(1, ITEM)]
    words = ITEM.split()
    docs = [(1, "x " + ITEM + " y"), (2, ", ".join(words[:12]).upper()), (3, " ".join(words[:11])), (4, None), (5, ""), (6, "\n".join(w + "​" for w in words[3:15])),
            (7, " ".join(words[:6] + ["other"] + words[6:])), (8, " ".join(words[:12]).replace("porous", "p&#111;rous")), (None, ITEM)]
    for i in range(60):
        source = rng.choice(items[5:35])[1].split()
        a, n = rng.randrange(15), rng.choice([8, 11, 12, 13])
        docs.append((100 + i, " ".join(rng.choices(vocabulary, k=40) + source[a : a + n] + rng.choices(vocabulary, k=40))))
    grams = defaultdict(set)
    for i, t in items:
        w = leaks.words_of(t)
        for k in range(len(w) - 11):
            grams[tuple(w[k : k + 12])].add(i)
    expected = {(d, i) for d, t in docs for w in [leaks.words_of(t)] for k in range(len(w) - 11) for i in grams.get(tuple(w[k : k + 12]), ())}
    df = spark.createDataFrame([(d, t, "clash") for d, t in docs], SCHEMA).repartition(4)
    it = spark.createDataFrame(items, "item_id bigint, item_text string")
    got = leaks.leaked(df, "doc_id", "body", it, "item_id", "item_text").collect()
    assert len(got) == len(set(got)) and set(map(tuple, got)) == expected
    assert leaks.leaked(df.where("false"), "doc_id", "body", it, "item_id", "item_text").count() == 0
    assert leaks.leaked(df, "doc_id", "body", it.where("false"), "item_id", "item_text").count() == 0
    near = {tuple(r) for r in leaks.leaked(df, "doc_id", "body", it, "item_id", "item_text", 0.9).collect()}
    assert near >= expected


def test_hamming_search_is_complete():
    import numpy as np

    rng = np.random.default_rng(1)
    p = leaks.Passages([(i, " ".join(f"{i}a{k}" for k in range(20))) for i in range(50)])
    near = p.prints[rng.integers(0, len(p.prints), 500)].copy()
    for b in rng.integers(0, 48, (500, 12)).T:  # no difference in the last block
        near ^= np.uint64(1) << b.astype(np.uint64)
    q = np.concatenate([near, rng.integers(0, 2**63, 500).astype(np.uint64)])
    at, w = p.near(q)
    agree = lambda x: sum(((p.prints ^ x) >> np.uint64(16 * b)) & np.uint64(0xFFFF) == 0 for b in range(4)) > 0
    brute = {(i, j) for i, x in enumerate(q) for j in np.flatnonzero((np.bitwise_count(p.prints ^ x) <= leaks.RADIUS) & agree(x))}
    assert set(zip(at.tolist(), w.tolist(), strict=True)) == brute and len(brute) >= 500


def test_edited_passages_are_found(spark):
    """Recall for passages of twelve words with one or two words replaced, and with one added or left out."""
    rng = random.Random(7)
    vocabulary = [f"w{i}" for i in range(3000)]
    items = [(i, " ".join(rng.choices(vocabulary, k=40))) for i in range(200)]
    docs, planted = [], {}
    for d in range(600):
        passage = items[d % 200][1].split()[3:15]
        kind = d % 4
        for at in rng.sample(range(12), 2 if kind == 1 else 1):
            if kind < 2:
                passage[at] = f"new{d}"
        if kind == 2:
            passage.insert(rng.randrange(1, 11), "added")
        if kind == 3:
            del passage[rng.randrange(1, 11)]
        docs.append((d, " ".join(rng.choices(vocabulary, k=60) + passage + rng.choices(vocabulary, k=60)), "x"))
        planted[d] = kind
    docs += [(1000 + d, " ".join(rng.choices(vocabulary, k=150)), "x") for d in range(200)]
    found = leaks.leaked(spark.createDataFrame(docs, SCHEMA), "doc_id", "body", spark.createDataFrame(items, "item_id bigint, item_text string"), "item_id", "item_text", 0.4)
    got = {tuple(r) for r in found.collect()}
    for kind in range(4):
        mine = [d for d, k in planted.items() if k == kind]
        assert sum((d, d % 200) in got for d in mine) >= 0.9 * len(mine), kind
    assert not {d for d, i in got if d >= 1000 or i != d % 200}


def test_items_in_slices(spark, monkeypatch):
    monkeypatch.setattr(leaks, "ITEM_WINDOWS_AT_ONCE", 100)
    items = [(i, " ".join(f"{i}a{k}" for k in range(20))) for i in range(40)]
    docs = [(i, f"before {t} after", "x") for i, t in items]
    found = leaks.leaked(spark.createDataFrame(docs, SCHEMA), "doc_id", "body", spark.createDataFrame(items, "item_id bigint, item_text string"), "item_id", "item_text")
    assert {tuple(r) for r in found.collect()} == {(i, i) for i, _ in items}


PROSE = "When the old bridge was opened, nobody in the town knew about it. She said that they would be back before the end of the week, and he did not believe her."
KINDS = {
    "prose": [PROSE, "Sorry, the page you asked for could not be found. It may have been moved or removed.", "Als der alte Turm geräumt wurde, war niemand in der Stadt. Wir haben die Leiter nicht gefunden.",
              "小さな橋は昨日ゆっくり直したそうですが、だれも理由を知りません。わたしたちは川のそばで灯台を見つけた。", "\n".join(PROSE[i : i + 50] for i in range(0, len(PROSE), 50))],
    "list": ["\n".join(f"- item {w}" for w in "abcdefghij"), "\n".join(f"{i}. lamp" for i in range(20)), "\n".join(["Spare pond.", "Slow well.", "Modest bucket."] * 6)],
    "table": ["\n".join(f"row{i}\t{i * 7}\t{i * 13}\t{i}.5" for i in range(12)), "\n".join(f"a{i};{i};{i * 3};12:30" for i in range(9))],
    "junk": ["click here " * 40, "\n".join("%CE%DF%02%46%48%B1&sid=sjfdwr" for _ in range(9)), "\n".join("var qq=function(){return i[374]};" for _ in range(9)), "ÐšÐ¾Ð½Ñ‚Ð°ÐºÑ‚Ñ‹ Ð’Ð¾Ð¹Ñ‚Ð¸ " * 9],
}


def test_statistics():
    s = dict(zip(textstats.STATS, statistics("One two three.\nfour"), strict=True))
    assert s["word_count"] == 4 and s["mean_word_length"] == pytest.approx((3 + 3 + 5 + 4) / 4) and s["symbol_ratio"] == pytest.approx(1 / 16)
    assert statistics(None) is statistics("") is statistics(" \n ") is None
    for kind, texts in KINDS.items():
        for t in texts:
            assert (statistics(t)[6] > 0.5) == (kind == "prose"), t


def test_punctuated_lines_are_counted():
    """One long sentence under nine lines of a menu, of which the wrapped ones are still lines."""
    s = dict(zip(textstats.STATS, statistics("\n".join(["Home", "about us", "News"] * 3 + [PROSE])), strict=True))
    assert s["punct_line_share"] == pytest.approx(0.1) and s["ended_share"] > 0.5


def test_scripts_without_word_lists():
    """Chinese, Korean, Arabic and Hindi sentences are prose; their items and repeated words are not."""
    for t in ("我们昨天在河边的小桥旁找到了那座旧灯塔，没有人知道它为什么还亮着。", "우리는 어제 강가의 작은 다리 옆에서 오래된 등대를 찾았고 아무도 그 이유를 몰랐다.",
              "وجدنا أمس المنارة القديمة قرب الجسر الصغير ولم يعرف أحد لماذا بقيت مضاءة.", "हमने कल नदी के किनारे छोटे पुल के पास पुराना दीपस्तंभ देखा और कोई कारण नहीं जानता था।"):
        assert statistics("\n".join([t] * 2))[6] > 0.5, t
    for t in ("旧灯塔\n小桥\n河边", "우리는 " * 30 + ".", "다리\n등대\n강가"):
        assert statistics(t)[6] == 0, t


def test_types(spark):
    rows = [(n, t) for n, (k, t) in enumerate((k, t) for k, ts in KINDS.items() for t in ts for _ in range(5))] + [(900, None), (901, ""), (902, "x" * 200_000)]
    kinds = {n: k for n, k in enumerate(k for k, ts in KINDS.items() for t in ts for _ in range(5))}
    stats = text_statistics(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3), "doc_id", "text")
    assert {r[0] for r in stats.where("votes is null").collect()} == {900, 901}
    types = text_types(stats, "doc_id")
    got = {r["doc_id"]: r["p_prose"] for r in types.collect()}
    wrong = [n for n, k in kinds.items() if (got[n] > 0.5) != (k == "prose")]
    assert not wrong, wrong
    assert all(abs(sum(r[1:]) - 1) < 1e-9 for r in types.collect())
    assert text_types(stats.where("false"), "doc_id").count() == 0


def test_the_model_decides():
    """Labellers that agree with each other overrule one that does not, and one that is mostly alone counts little."""
    counts = {"pppp------": 900, "llll------": 900, "plll------": 60, "lppp------": 60, "jppp------": 40, "p---------": 20}
    post = textstats.posteriors(counts)
    assert post["plll------"][1] > 0.9 and post["lppp------"][0] > 0.9 and post["jppp------"][0] > 0.9 and post["p---------"][0] > 0.5
    # the first one's votes are random here, so what it says alone is not worth much
    noise = {a + b: 200 for a in "pltj" for b in ("ppp------", "lll------")} | {"p---------": 10}
    post = textstats.posteriors(noise)
    assert post["p---------"][0] < 0.7 and post["lppp------"][0] > 0.9


def test_types_against_labels(spark):
    """Held-out accuracy: the labels are used nowhere else, and some of them are wrong."""
    from vecledger.sources.tables import table

    d = "/root/testdata/sf0.01"
    labels: dict[int, Counter] = defaultdict(Counter)
    for r in table(spark, d, "page_labels").where("kind_label is not null").distinct().collect():
        labels[r["doc_id"]][r["kind_label"]] += 1
    stats = text_statistics(table(spark, d, "documents"), "doc_id", "text")
    prose = {r["doc_id"]: r["p_prose"] > 0.5 for r in text_types(stats, "doc_id").collect()}
    sure = {i: c.most_common(1)[0][0] == "prose" for i, c in labels.items() if len(c) == 1 and i in prose}
    assert sum(prose[i] == v for i, v in sure.items()) >= 0.93 * len(sure) > 50


def test_votes_are_letters():
    patterns = {}
    statistics(PROSE + "\n- a\n1;2;3", patterns)
    assert set("".join(patterns)) <= set(textstats.LETTERS) and {len(p) for p in patterns} == {10} and sum(patterns.values()) == len(PROSE) + 8


@pytest.mark.parametrize("buffer", [3, 10_000])
def test_top_n(spark, buffer, monkeypatch):
    from vecledger.llm import topn

    monkeypatch.setattr(topn, "BUFFER_ROWS", buffer)
    rng = random.Random(4)
    rows = [(rng.choice([None, 1, 1, 1, 1, 2, 3]), rng.choice([0.5, 1.0, float("nan"), None, -2.0]), f"i{n}", n) for n in range(700)] + [(9, 1.0, "only", 0)]
    df = spark.createDataFrame(rows, "g int, score double, id string, rank int").repartition(5)
    got = top_n(df, ["g"], [("score", "descending"), ("id", "ascending")], 5)
    key = lambda r: (2 if r[1] is None else 1 if r[1] != r[1] else 0, -r[1] if r[1] is not None and r[1] == r[1] else 0, r[2])
    expected = {g: [r[2] for r in sorted((r for r in rows if r[0] == g), key=key)[:5]] for g in {r[0] for r in rows}}
    found = defaultdict(list)
    for r in got.collect():
        found[r["g"]].append(r["id"])
    assert {g: sorted(v) for g, v in found.items()} == {g: sorted(v) for g, v in expected.items()}
    assert got.columns == df.columns and top_n(df.where("false"), ["g"], [("id", "ascending")], 5).count() == 0
