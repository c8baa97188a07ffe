import numpy as np
import pytest
from pyspark.sql import functions as F

from mirefold.llm.garbled import GRID, Restorer, aligned, explain, learn, mapped, restored, transform, well_formed

NAMES = ["Zoénard Réton", "Hélvault Cléton", "Hülwald Rädmann", "Müllinde Götter", "Núñera Álvón", "Jiméana Ordóido", "Горова Малаков", "Росова Лесченко", "Белаков Зарюк"]
CLEAN = [f"{n} wrote about café order {k} and the Übersicht number {k * 7}" for k, n in enumerate(NAMES * 40)]


def damage(text, read, meant):
    return text.encode(meant).decode(read, "replace")


@pytest.fixture(scope="module")
def model(spark):
    bad = [damage(CLEAN[i], r, m) for i, (r, m) in enumerate([("latin-1", "utf-8"), ("cp437", "utf-8"), ("cp1251", "utf-8")] * 6) if all(ord(c) < 256 for c in CLEAN[i])]
    texts = CLEAN + bad
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, v string")
    return learn(df, {"v": F.col("v")})


def test_alignment_explains():
    found = {GRID[i] for i in explain("CafÃ© Ã¼ber", "Café über")}
    assert ("cp1252", "utf-8", 1) in found
    assert explain("Café", "Café") == frozenset() and explain("Café", "Cafeé é") == frozenset()
    assert ("cp437", "cp1252", 1) in {GRID[i] for i in explain("CafΘ", "Café")}
    assert transform("Ã©", "cp1252", "utf-8", 1) == "é" and transform("é", "cp1252", "utf-8", 1) is None


def test_learns_from_twins(model):
    assert ("cp1252", "utf-8", 1) in model.transformations and ("cp437", "utf-8", 1) in model.transformations


def test_restores_what_has_no_twin(model):
    text = "Réponse à Zoénard: café order"
    out, what = model(damage(text, "latin-1", "utf-8"))
    assert what == "restored" and "Zoénard" in out and "café" in out
    assert model("Zoénard Réton wrote about café order 5") == ("Zoénard Réton wrote about café order 5", None)
    assert model("Caf� order")[1] == "lost"
    assert model("") == ("", None) and model("plain") == ("plain", None)


def test_table(spark, model):
    rows = [(1, damage(CLEAN[0], "latin-1", "utf-8")), (2, CLEAN[1]), (3, None), (4, ""), (1, damage(CLEAN[0], "latin-1", "utf-8")), (5, "x" * 50_000 + " �")]
    df = spark.createDataFrame(rows, "id long, v string").withColumn("status", F.lit("clash"))
    out = restored(df, "id", {"v": F.col("v")}, model).collect()
    assert sorted((r["row_id"], r["status"]) for r in out) == [(1, "restored"), (1, "restored"), (5, "lost")]
    assert restored(df.limit(0), "id", {"v": F.col("v")}, model).count() == 0


def test_nothing_to_learn(spark):
    empty = spark.createDataFrame([], "id long, v string")
    m = learn(empty, {"v": F.col("v")})
    assert m.transformations == [] and m("Café") == ("Café", None)
    assert isinstance(m, Restorer) and m.log_counts.max() <= np.log(0.5) + 1e-6


@pytest.mark.parametrize("text", ["Viele Grüße aus Köln", "С уважением, Росова", "Réponse à l’été – ça va"])
def test_well_formed_runs(text):
    bad = "clean line é\n" + damage(text, "latin-1", "utf-8")
    assert well_formed(bad) == "clean line é\n" + text
    assert well_formed(damage(damage(text, "latin-1", "utf-8"), "latin-1", "utf-8")) == text
    assert well_formed(text) == text and well_formed("") == ""


def test_copies_of_a_garbled_message_do_not_make_it_usual(spark):
    clean = [f"Report from office {a}{b}xyz: проверьте договор сегодня вечером" for a in "abcdef" for b in "ghijkl"]
    bad = [damage(t, "cp1251", "koi8-r") for t in clean[:4]]
    bulk = damage("Bulk letter to everybody here: просим проверить договор вечером", "cp1251", "koi8-r")
    df = spark.createDataFrame(list(enumerate([*clean, *bad, *[bulk] * 40])), "id long, v string")
    fields = {"v": F.col("v")}
    assert {r["row_id"] for r in restored(df, "id", fields, learn(df, fields)).collect()} == set(range(36, 80))


def test_alignment_by_character():
    assert aligned("caf@@ über", "caf@@ über") == {}
    assert aligned("x ⌂⌘ y ⌂", "x éü y é") == {"⌂": "é", "⌘": "ü"}
    assert aligned("x ⌂⌘⌂⌘", "x éé") == {"⌂⌘": "é"}
    assert aligned("x ⌂⌂", "x éü") is None and aligned("⌂⌘⌂", "éé") is None and aligned("plain", "plain") is None
    assert mapped("⌂⌘⌂", {"⌂": "é", "⌘": "ü"}, 1) == "éüé" and mapped("⌂⍟", {"⌂": "é"}, 1) is None
    assert mapped("⌂⌘⌂", {"⌂⌘": "é", "⌂": "ü"}, 2) == "éü"


PLANTED = str.maketrans("éèöüäßñóíáôçÉÖÜ", "⌂⌘⍟⎔⎈⏣⏏⏚⎋⌬⌭⌯⍾⎚⎍")


def test_a_mapping_outside_any_encoding_is_learned(spark):
    bad = [c.translate(PLANTED) for c in CLEAN[:18]]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(CLEAN + bad)], "id long, v string")
    model = learn(df, {"v": F.col("v")})
    assert model.mapping["⌂"] == "é" and not any(c in model.mapping for c in "éüö")
    text = "Réponse: Zoénard Réton, über Müllinde"
    assert model(text.translate(PLANTED)) == (text, "restored") and model(text) == (text, None)
    nothing = learn(df.where(f"id < {len(CLEAN)}"), {"v": F.col("v")})  # without twins nothing is learned
    assert not nothing.mapping and not nothing.transformations and nothing(text.translate(PLANTED))[1] is None


def test_the_usual_writing_is_the_clean_one_even_where_a_garbled_one_has_more_copies(spark):
    hot = damage(CLEAN[0], "cp1252", "utf-8")
    df = spark.createDataFrame([(i, t) for i, t in enumerate(CLEAN + [hot] * 500 + [damage(CLEAN[1], "cp1252", "utf-8")])], "id long, v string")
    model = learn(df, {"v": F.col("v")})
    assert ("cp1252", "utf-8", 1) in model.transformations and ("utf-8", "cp1252", 1) not in model.transformations
    assert model(hot) == (CLEAN[0], "restored") and model(CLEAN[0])[1] is None


def test_share_of_right_restorations(spark, small):
    """Clean lines of the tables, damaged and restored: at least nine of ten come out as they were."""
    q = pytest.importorskip("mirefold.llm.queries")
    model = q._restorer(spark, small)
    lines = [x for r in q._garbled_fields(spark, small)[0].select("text").where("text is not null").collect() for x in r["text"].split("\n") if not x.isascii()]
    clean = [x for x in dict.fromkeys(lines) if model(x)[1] is None and len([c for c in x if ord(c) > 127]) > 2][:400]
    learned = [(r, m) for r, m, n in model.transformations if n == 1][:4]
    right = total = 0
    for read, meant in learned:
        for x in clean:
            try:
                bad = x.encode(meant).decode(read)
            except (UnicodeEncodeError, UnicodeDecodeError):
                continue
            if bad != x:
                total += 1
                right += model(bad)[0] == x
    assert total > 100 and right >= 0.9 * total, (right, total)
