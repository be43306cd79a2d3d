"""Reading levels (held-out accuracy), the mail reader and the grouping of listings."""

import base64
import os
import random

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from cotejo.llm.listings import GRAMS, all_pairs, batch_cosines, same_item_groups, vocabulary
from cotejo.llm.mail import own_text
from cotejo.llm.parse import brand_key, parse_listing
from cotejo.llm import reading
from cotejo.llm.reading import FLOOR, PASSED_VARIANCE, PASSED_WEIGHT, PRIOR, TOLERANCE, author_sentences, blocks, propagate, reading_levels
from cotejo.session import cut

SF = "/root/testdata/sf0.1"
OWN = "El precio informado incluye el transporte hasta la obra. Faltan algunas planchas."
B64 = base64.b64encode(f"Hola Ana,\n\n{OWN}\n\nSaludos,\n\n--\nJuan\nRUT 1-9".encode()).decode()
NESTED = f"""From: a@x.example
Content-Type: multipart/mixed;
 boundary="=_b"

--=_b
Content-Type: multipart/alternative; boundary="=_b_alt"

--=_b_alt
Content-Type: text/plain; charset="utf-8"
Content-Transfer-Encoding: base64

{B64}
--=_b_alt
Content-Type: text/html

<p>otro</p>
--=_b_alt--
--=_b
Content-Type: text/csv
Content-Disposition: attachment; filename="a.csv"

adjunto
--=_b--
"""


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        (NESTED, OWN),
        (NESTED.replace("\n", "\r\n"), OWN),
        (f"Subject: x\n\nBuenas tardes,\n\n{OWN}\n\nAtte.,\n\nAna\n\nEl lunes, Ana escribió:\n> viejo", OWN),
        (f"Subject: x\n\nEl 3 Mar 2026, Ana escribió:\nviejo texto\n> más\n\nAna:\n\n{OWN}\n\nAVISO LEGAL: no imprimir.", OWN),
        (f"Subject: x\n\n{OWN}\n\n-----Mensaje original-----\nDe: Ana\nEnviado: ayer\n\nviejo", OWN),
        (f"Subject: x\nContent-Type: text/html\n\n<html><body><p>Hola Ana,</p><p>{OWN}</p><p>Saludos,</p><blockquote>viejo<blockquote>más</blockquote></blockquote></body></html>", OWN),
        ("Subject: x\nContent-Transfer-Encoding: quoted-printable\nContent-Type: text/plain; charset=utf-8\n\nma=C3=B1ana =\nsale.", "mañana sale."),
        (OWN, OWN), ("", ""), (None, ""), ("Subject: only headers", ""),
    ],
)
def test_own_text(raw, want):
    assert own_text(raw) == want


def test_own_text_of_long_and_broken_input():
    assert own_text("Subject: x\n\n" + "palabra " * 200_000).startswith("palabra")
    assert isinstance(own_text('Content-Type: multipart/mixed; boundary="b"\n\n--b\nContent-Transfer-Encoding: base64\n\n%%%=\n--b'), str)


def test_parts_nested_to_any_depth():
    raw = "Content-Type: text/plain\n\nel informe llega hoy"
    for k in range(60):
        raw = f'Content-Type: multipart/mixed; boundary="b{k}"\n\n--b{k}\n{raw}\n--b{k}--\n'
    assert own_text(raw) == "el informe llega hoy"


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables absent")
def test_held_out_accuracy(spark):
    docs, marks = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/reading_sample.parquet")
    train, held = marks.filter("doc_id % 2 = 0"), marks.filter("doc_id % 2 = 1")
    got = reading_levels(docs, train).join(held.withColumnRenamed("nivel", "want"), "doc_id").collect()
    assert len(got) == held.count() and sum(r["nivel"] == r["want"] for r in got) / len(got) >= 0.95


def test_python_gets_blocks_one_at_a_time(spark, monkeypatch):
    def one_at_a_time(of):
        def run(batches):
            def checked():
                for b in batches:
                    assert b.num_rows <= 1
                    yield b

            return of(checked())

        return run

    monkeypatch.setattr(reading, "_gather", one_at_a_time(reading._gather))
    docs = spark.createDataFrame([(i, f"{OWN} {OWN}") for i in range(300)], "doc_id long, text string").coalesce(1)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    got = reading_levels(docs, spark.createDataFrame([(1, 2), (2, 3)], "doc_id long, nivel int"), min_words=2, block_docs=5)
    assert got.count() == 300
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before


def test_parsed_documents_have_small_row_groups(spark, monkeypatch):
    monkeypatch.setattr(reading, "GROUP_BYTES", 1 << 16)
    sizes = []
    plain = reading.cut

    def kept(df, name, *more):
        c = plain(df, name, *more)
        if name == "sentences":
            files = [f for f in os.listdir(c.path.removeprefix("file://")) if f.endswith(".parquet")]
            metas = [pq.ParquetFile(os.path.join(c.path.removeprefix("file://"), f)).metadata for f in files]
            sizes.extend(m.row_group(i).num_rows for m in metas for i in range(m.num_row_groups))
        return c

    monkeypatch.setattr(reading, "cut", kept)
    words = " ".join(f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(600))
    docs = spark.createDataFrame([(i, f"{words} x{i}") for i in range(400)], "doc_id long, text string").coalesce(1)
    reading_levels(docs, spark.createDataFrame([(1, 2)], "doc_id long, nivel int")).count()
    assert sum(sizes) == 400 and len(sizes) > 1


def grading(rows, graded):
    """Brute force of the rounds: (sentence word lists with their document) and grades of documents."""
    mean = sum(graded.values()) / len(graded)
    nodes = [(doc, w + list(zip(w, w[1:], strict=False))) for doc, w in rows]
    score, say, rounds = {}, {}, 0
    while True:
        sums = {}
        for doc, ns in nodes:
            known = [n for n in ns if n in score]
            if doc in graded:
                d, weight, extra = graded[doc], 1.0, 0.0
            elif known:
                d, weight, extra = sum(score[n] * say[n] for n in known) / sum(say[n] for n in known), PASSED_WEIGHT, PASSED_VARIANCE
            else:
                continue
            for n in ns:
                a = sums.setdefault(n, [0.0, 0.0, 0.0])
                a[0] += weight
                a[1] += weight * d
                a[2] += weight * (d * d + extra)
        new = {n: (s + PRIOR * mean) / (k + PRIOR) for n, (k, s, _) in sums.items()}
        moved = max(abs(v - score.get(n, 0.0)) for n, v in new.items())
        score, say, rounds = new, {n: 1 / (max(q / k - (s / k) ** 2, 0.0) + FLOOR) for n, (k, s, q) in sums.items()}, rounds + 1
        if moved <= TOLERANCE:
            return score, rounds


@pytest.mark.parametrize("block_docs", [2, 1000])
def test_rounds_match_brute_force_and_end(spark, monkeypatch, block_docs):
    rnd = random.Random(5)
    docs = {i: [[rnd.choice("abcdefghij"[: 4 + i % 7]) * 3 for _ in range(rnd.randint(1, 6))] for _ in range(5)] for i in range(12)}
    graded = {0: 1.0, 6: 3.0, 7: 2.0}
    table = spark.createDataFrame([(i, "Subject: x\n\n" + ". ".join(" ".join(s) for s in d)) for i, d in docs.items()], "doc_id long, text string")
    marks = spark.createDataFrame(list(graded.items()), "doc_id long, grade double")
    packed = blocks(author_sentences(table, 1).join(marks, "doc_id", "left"), block_docs)
    scores, rounds = propagate(cut(packed, "blocks").df)
    want, n = grading([(i, s) for i, d in docs.items() for s in d], graded)
    assert rounds == n and np.allclose(sorted(r["score"] for r in scores.df.collect()), sorted(want.values()))
    monkeypatch.setattr(reading, "MAX_ROUNDS", 2)
    with pytest.raises(RuntimeError, match="not stable"):
        propagate(cut(packed, "blocks").df, tolerance=-1.0)


def test_levels_of_odd_tables(spark):
    text = "Subject: x\n\n" + "La pala llega hoy con el balde. " * 10
    docs = spark.createDataFrame([(1, text, "clash"), (2, None, "c"), (None, text, "c"), (3, "corto", "c")], "doc_id long, text string, nivel string")
    none = spark.createDataFrame([], "doc_id long, nivel int")
    assert [tuple(r) for r in reading_levels(docs, none).select("doc_id", "nivel").collect()] == [(1, 2)]
    marks = spark.createDataFrame([(1, 1), (1, 3), (None, 1), (9, None)], "doc_id long, nivel int")
    assert [tuple(r) for r in reading_levels(docs, marks).select("doc_id", "nivel").collect()] == [(1, 3)]
    assert reading_levels(docs.limit(0), marks).collect() == []


def test_parse_listing():
    w, m, b = parse_listing("Clavo corriente 2 1/2'' X 0,5 KG Zuncor Bagimanofe (precio por kg)", "Zun-Cor®")
    assert m == {"small": "64", "mass": "0.5"} and b == "zuncor" and "bagimanofe" in w
    same = [parse_listing(n, None)[1] for n in ("Látex 1 gl azl", "Latex 3,79 lt tono azul", "LATEX 3785 CC BLUE")]
    assert same[0] == same[1] == same[2] == {"volume": "3.8", "colour": "azul"}
    assert parse_listing("Esmeril FK-3125, 720W, pack 6,", "x")[1] == {"model": "fk3125", "power": "720", "count": "6"}
    assert parse_listing("Gres 60 x 30 cms", None)[1] == parse_listing("Gres 0,3 x 0,6 m", None)[1]
    assert parse_listing(None, None) == ([], {}, "") and brand_key("Sin Marca") == ""
    assert parse_listing("x" * 200_000, "y" * 200_000)[1] == {}


ROWS = [
    ("a1", "Látex interior Kabibijogo 1 gl azul Brovanta", "Brovanta", 100), ("a2", "pintura latex - kabibijogo - 3785 cc - blue", None, 110), ("a3", "Latex Kabibijgo 1 galón azl", "S/M", 95),
    ("a4", "Pintura látex Kabibijogo azul", "Brovanta", 104), ("b1", "Látex Kabibijogo 4 gal azul", "Brovanta", 380), ("b2", "Latex Kabibijogo 15,14 lt azul", None, 390),
    ("c1", "Látex Kabibijogo 1 gl rojo", "Brovanta", 100), ("d1", "Tubo PVC Pepolagole 110 mm 3 m", "X", 10), ("d2", "Cañería Pepolagole 11cm x 3000 mm", "Y", 10), ("e", None, None, None), ("f", "", None, 5), ("a1", "Látex interior Kabibijogo 1 gl azul Brovanta", "Brovanta", 100),
]


#: other articles, so that words of kind and brand are common and lines are rare, as in any catalogue
OTHERS = [(f"o{i:02}", f"{k} {''.join(c + 'aeiou'[i % 5] for c in f'{i:03}'.translate(str.maketrans('0123456789', 'bcdfgklmnr')))}zo {b} interior", b, 50) for i in range(60) for k, b in [("Pintura Látex", "Brovanta") if i % 2 else ("Cañería Tubo PVC", "Grelmado")]]


def test_same_items(spark):
    d = spark.createDataFrame(ROWS + OTHERS, "id string, name string, brand string, price long").withColumn("words", F.lit("clash"))
    g = same_item_groups(d, "id", "name", "brand", F.col("price"))
    got = {tuple(r) for r in all_pairs(g, "l", "r").collect()}
    a = ["a1", "a2", "a3", "a4"]
    # the two sizes and the colours stay apart, the size that a4 leaves out is told by its price, other brands are vetoed
    assert got == {(x, y) for x in a for y in a if x < y} | {("b1", "b2")}


def test_same_items_of_hot_copies_and_empty(spark):
    rows = [(f"h{i:03}", "Cemento Bivanikaga 25 kg", "Z", 5) for i in range(120)] + [("x", "Cemento Bivanikaga 40 kg", "Z", 9)]
    d = spark.createDataFrame(rows, "id string, name string, brand string, price long")
    g = same_item_groups(d, "id", "name", "brand", F.col("price")).collect()
    assert len(g) == 120 and {r["group_id"] for r in g} == {"h000"}
    assert same_item_groups(d.limit(0), "id", "name", "brand", F.col("price")).collect() == []


def test_spelling_repair_and_cosine(spark):
    words = ["percutor"] * 9 + ["percuotr", "percutorr", "percuto", "martillo", "martillos"]
    v = {r["word"]: r["fixed"] for r in vocabulary(spark.createDataFrame([(w,) for w in words], "word string")).collect()}
    assert v["percuotr"] == v["percutorr"] == v["percuto"] == "percutor" and v["martillos"] == "martillos"
    x, y = pa.array([["abc", "abc"], ["abc"], [], None], pa.list_(pa.string())), pa.array([["abc", "xyz"], ["xyz"], [], None], pa.list_(pa.string()))
    assert batch_cosines(x, y, np.ones(GRAMS), {}).round(3).tolist() == [0.707, 0.0, 0.0, 0.0]


def _pairs(spark, rows):
    d = spark.createDataFrame(rows + OTHERS, "id string, name string, brand string, price long")
    known = {r[0] for r in rows}
    return {tuple(r) for r in all_pairs(same_item_groups(d, "id", "name", "brand", F.col("price")), "l", "r").collect() if r[0] in known}


def test_listings_whose_rarest_words_differ_meet(spark):
    rows = [
        ("a1", "Tubo PVC Rivokesge 32 mm 3 m", "Brovanta", 100), ("a2", "Tubo PVC Rivokesoge 32 mm 3 m", "Brovanta", 104),  # as rare as each other
        ("b1", "Tubo PVC Dapofolafi 2 in", "Grelmado", 10), ("b2", "Tubo PVC Dapoflafi 3 in", "Grelmado", 10),  # another measure
        ("c1", "Pintura Latex Segaroseno 4 gal gris", "Brovanta", 50), ("c2", "Pintura Ltex Segaroseno 15142 cc gray", "Brovanta", 52),  # a short stray word is rarer than the line
        ("c3", "Pintura Latex Segaroseno 4 gal gris", "Brovanta", 51), ("c4", "Pintura Ltex Numabifago 4 gal gris", "Brovanta", 51),
    ]
    assert _pairs(spark, rows) == {("a1", "a2"), ("c1", "c2"), ("c1", "c3"), ("c2", "c3")}


def test_every_brand_of_a_block_and_listings_of_odd_words_find_their_group(spark):
    rows = [
        ("a1", "Tubo PVC Pepolagole 110 mm 3 m", "Xerra", 10), ("a2", "Tubo PVC Pepolagole 110 mm 3 m", "Yanka", 20), ("a3", "Tubo PVC Pepolagole 11 cm 3 m", "Xerra", 10), ("a4", "Tubo Pepolagole 110 mm 3 m", "Yanka", 20),
        ("a5", "Tubo PVC Pepolagole 110 mm 3 m", None, 20), ("a6", "Tubo PVC Pepolagole Xerra 110 mm 3 m", None, 14),
        ("b1", "Lubapimeko " + " ".join(f"{a}{b}quizorvexajuk" for a in "bcdfg" for b in "aeiou"), None, 7), ("b2", "Tubo PVC Lubapimeko interior", None, 7), ("b3", "Tubo PVC Lubapimeko", None, 7),
    ]
    got = _pairs(spark, rows)
    assert {("a2", "a4"), ("a2", "a5"), ("a4", "a5"), ("a1", "a3"), ("a1", "a6"), ("a3", "a6"), ("b2", "b3")} == got
