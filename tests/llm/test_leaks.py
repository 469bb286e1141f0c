import base64
import quopri
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from forkline.llm import leaks, queries
from forkline.llm.reader import from_base64, visible_parts, without_markup

from .. import conftest

ITEM = "Nobody in Lornholt could say why the weather vane faced inland, although an almanac from 1582 blames her mother's quarrel over 843 barrels of lamp oil."
WORDS = ITEM.split()


def mail(body, kind="text/plain; charset=utf-8", encoding="8bit"):
    return f"From: a@b.example\nSubject: x\nContent-Type: {kind}\nContent-Transfer-Encoding: {encoding}\n\n{body}\n"


def held(spark, texts, items=((1, ITEM),)):
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], "doc_id bigint, text string, k string, id int")
    found = leaks.leaked(docs, spark.createDataFrame(list(items), "item_id bigint, item_text string"))
    return sorted(map(tuple, found.collect()))


def test_what_makes_no_difference(spark):
    half = " ".join(WORDS[:13])
    forms = [
        ITEM, mail(ITEM), mail(base64.encodebytes(ITEM.encode()).decode(), encoding="base64"), mail(quopri.encodestring(ITEM.encode()).decode(), encoding="quoted-printable"),
        mail("<p>" + ITEM.replace("weather", "<b>wea</b>ther").replace("'", "&#39;").replace(" ", "&nbsp; ", 3) + "</p>", "text/html"),
        mail("\n".join("> > " + " ".join(WORDS[i : i + 5]) for i in range(0, len(WORDS), 5))), mail("\r\n".join(WORDS)), mail(ITEM.upper()), mail(ITEM.replace(",", " -").replace("'", "")),
        mail(ITEM.replace("e", "\u0435").replace("o", "\u03bf").replace("W", "\uff37").replace("in", "i\u200bn")), mail("before " + half + " after"),
        "From: a@b.example\nContent-Type: multipart/mixed;\n boundary=\"=_x\"\n\nintro\n--=_x\nContent-Type: text/plain\n\nhello\n--=_x\nContent-Type: text/plain; name=n.txt\nContent-Transfer-Encoding: base64\n\n"
        + base64.encodebytes(ITEM.encode()).decode() + "--=_x--\n",
    ]
    assert held(spark, forms) == [(i, 1) for i in range(len(forms))]


def test_what_breaks_a_run(spark):
    short = " ".join(WORDS[:12])
    middle = len(WORDS) // 2
    broken = [
        mail(short), mail(" ".join(WORDS[:middle] + ["very"] + WORDS[middle:])[::1].replace("Nobody", "Everybody")), mail(" ".join(WORDS[:11] + WORDS[12:20])), mail("x" + short + " x"),
        mail(base64.encodebytes(ITEM.encode()).decode(), "application/zip", "base64"), mail("x" + " ".join(WORDS[1:13])), None, "",
    ]
    assert len(WORDS) == 26
    # one word more in the middle still leaves a whole half on one side: 13 of 26 words
    assert held(spark, broken) == [(1, 1)]


def test_edges(spark):
    assert held(spark, [ITEM, ITEM], [(1, ITEM), (1, ITEM), (2, None), (3, ""), (4, "?!"), (None, ITEM)]) == [(0, 1), (1, 1)]
    assert held(spark, ["one", "two one", "twoone"], [(1, "one"), (2, "two words")]) == [(0, 1), (1, 1), (1, 2)]
    assert held(spark, [ITEM], [(5, None)]) == []
    two = spark.createDataFrame([(1, "short"), (1, "x " * 500 + ITEM), (1, None), (None, None)], "doc_id bigint, text string")
    assert leaks.leaked(two, spark.createDataFrame([(1, ITEM), (None, None)], "item_id bigint, item_text string")).collect() == [(1, 1)]
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    items = spark.createDataFrame([(1, ITEM)], "item_id bigint, item_text string")
    assert leaks.leaked(docs, items).count() == 0
    assert leaks.leaked(docs, items.limit(0)).count() == 0


def test_long_text_is_searched_whole(spark, monkeypatch):
    monkeypatch.setattr(leaks, "SLICE", 1000)
    rnd = random.Random(1)
    filler = [rnd.choice(["alpha", "beta", "gamma", "delta"]) + str(rnd.randrange(100)) for _ in range(20000)]
    for at in (0, 777, 19999):
        text = " ".join(filler[:at] + WORDS + filler[at:])
        codes, starts = leaks.letters(visible_parts(text))
        item = leaks.Item(ITEM)
        k, w = leaks._class_of(item.shortest)
        mine = {int(h): int(q) for q, h in zip(*leaks.winnowed(item.codes, k, w))}
        runs = [leaks.longest_run(codes, starts, item, int(p) - mine[int(h)]) for p, h in zip(*leaks.winnowed(codes, k, w)) if int(h) in mine]
        assert max(runs) == len(WORDS)


def test_slices_do_not_change_prints(monkeypatch):
    codes = np.random.default_rng(1).integers(97, 101, 5000).astype(np.uint32)
    codes[[100, 2500, 2501]] = leaks.GAP
    whole = [x.tolist() for x in leaks.winnowed(codes, 8, 9)]
    monkeypatch.setattr(leaks, "SLICE", 300)
    sliced = [x.tolist() for x in leaks.winnowed(codes, 8, 9)]
    assert set(whole[0]) <= set(sliced[0]) and dict(zip(*sliced)).items() >= dict(zip(*whole)).items()


@settings(max_examples=200, deadline=None)
@given(st.data())
def test_every_long_shared_span_shares_a_print(data):
    k, w = data.draw(st.sampled_from([(1, 1), (1, 2), (3, 6), (24, 41)]))
    draw = lambda n, m: data.draw(st.lists(st.integers(97, 99), min_size=n, max_size=m))
    shared = draw(w + k - 1, w + k + 10)
    a, b = (np.array(draw(0, 30) + shared + draw(0, 30), np.uint32) for _ in range(2))
    assert set(leaks.winnowed(a, k, w)[1].tolist()) & set(leaks.winnowed(b, k, w)[1].tolist())


def test_a_window_keeps_its_rightmost_least():
    codes = np.array([ord("a"), ord("b")] * 500, np.uint32)
    where, _ = leaks.winnowed(codes, 4, 10)
    assert len(where) <= 500 and set(np.diff(where)) == {2}
    rnd = np.random.default_rng(3).integers(97, 100, 400).astype(np.uint32)
    hashes = leaks.gram_hashes(rnd, 5)
    low = np.uint64((1 << (leaks.SLICE + 7 + 5).bit_length()) - 1)
    top = hashes & ~low
    want = {max(range(s, s + 7), key=lambda i: (-int(top[i]), i)) for s in range(len(hashes) - 6)}
    assert set(leaks.winnowed(rnd, 5, 7)[0].tolist()) == want


def test_repeated_words_stay_linear(spark):
    # every fingerprint of the item meets every one of the document
    item = "lamp " * 200
    docs = spark.createDataFrame([(1, "lamp " * 5000), (2, "lamp " * 99), (3, "lamp " * 100)], "doc_id bigint, text string")
    assert sorted(map(tuple, leaks.leaked(docs, spark.createDataFrame([(7, item)], "item_id bigint, item_text string")).collect())) == [(1, 7), (3, 7)]
    k, w = leaks._class_of(leaks.Item(item).shortest)
    codes = leaks.letters(["lamp " * 5000])[0]
    places = {int(a) - int(b) for a in leaks.winnowed(codes, k, w)[0] for b in leaks.winnowed(leaks.Item(item).codes, k, w)[0]}
    assert len(places) <= 5200


def test_gram_hashes_depend_on_the_gram_only():
    codes = np.array(list(b"abcabcabc") + [leaks.GAP] + list(b"abc"), np.uint32)
    for k in range(1, 8):
        hashes = leaks.gram_hashes(codes, k)
        grams = [tuple(codes[i : i + k]) for i in range(len(codes) - k + 1)]
        for g, h in zip(grams, hashes):
            assert (h == leaks._NONE) == (leaks.GAP in g)
        assert len({h for g, h in zip(grams, hashes) if leaks.GAP not in g}) == len({g for g in grams if leaks.GAP not in g})


def test_item_texts_of_hits_are_not_broadcast(spark):
    # both sides of the last join are small enough in the files for Spark to broadcast them
    docs = spark.range(1000).selectExpr("id AS doc_id", f"concat('note ', id, ' ', \"{ITEM}\") AS text")
    items = spark.range(20).selectExpr("id AS item_id", f"\"{ITEM}\" AS item_text")
    found = leaks.leaked(docs, items)
    plan = found._jdf.queryExecution().executedPlan().toString()
    last = next(line for line in plan.splitlines() if "Join [doc_id" in line)
    assert "SortMergeJoin" in last and "Inner" in last
    assert found.count() == 20_000


def test_archive_matches_brute_force(spark):
    docs = spark.read.parquet(f"{conftest.DATA}/documents.parquet").collect()
    items = {r.item_id: leaks.Item(r.item_text) for r in spark.read.parquet(f"{conftest.DATA}/eval_items.parquet").collect()}
    want = set()
    for d in docs:
        codes, starts = leaks.letters(visible_parts(d.text or ""))
        stream = codes.tobytes()
        for i, item in items.items():
            for a in range(len(item.ends) - item.needed + 1):
                piece = item.codes[item.begins[a] : item.ends[a + item.needed - 1]]
                p = stream.find(piece.tobytes())
                if p >= 0 and p % 4 == 0 and starts[p // 4] and starts[p // 4 + len(piece)]:
                    want.add((d.doc_id, i))
    assert {tuple(r) for r in queries.p7_found(spark, conftest.DATA).collect()} == want and want


@pytest.mark.parametrize(
    "text, want",
    [
        ("plain words", ["plain words"]), ("a: b\n\nbody", ["body"]), ("\n\nbody", ["\n\nbody"]), ("Content-Type: text/html\n\n<p>a<br>b &amp; <i>c</i></p><style>x</style>", ["\na\nb & c\n "]),
        ("Content-Type: multipart/mixed; boundary=b\n\n--b\nContent-Type: image/png\n\nAAAA\n--b\n\ntext\n--b--", ["text"]), ("Content-Type: multipart/mixed; boundary=b\n\nno parts", ["no parts"]),
        ("Content-Transfer-Encoding: base64\n\naGVsbG8gd29ybGQ\n", ["hello world"]), ("Content-Type: message/rfc822\n\nSubject: x\n\ninner", ["inner"]), ("", []),
    ],
)
def test_reader(text, want):
    assert visible_parts(text) == want


def test_cut_base64():
    whole = base64.encodebytes(b"some longer text to be cut").decode()
    for n in range(len(whole)):
        assert b"some longer text to be cut".startswith(from_base64(whole[:n]))
    assert without_markup("2 < 3 and <b>4</b> > 1") == "2 < 3 and 4 > 1"
