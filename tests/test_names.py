"""Names: scripts, folding, keys and similarity."""

import pytest
from pyspark.sql import functions as F

from tessera.functions import names as N
from tessera.functions.strings import jaro_winkler_of
from tessera.operators import blocking


def _one(spark, names, column):
    rows = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i int, n string")
    return [r[0] for r in rows.select("i", column(F.col("n")).alias("v")).orderBy("i").select("v").collect()]


def test_transliteration(spark):
    got = _one(spark, ["ಬಸಪ್ಪ", "ಮಂಜುನಾಥ", "ರಮೇಶ", "ಕೃಷ್ಣಪ್ಪ", "ತಂದೆ", "ಬಿನ್", "Ramesh K"], N.transliterate)
    assert got == ["basappa", "manjunaatha", "rameesha", "krishnappa", "tande", "bin", "Ramesh K"]


ALIKE = [("Ramesh", "ರಮೇಶ"), ("Manjunath", "ಮಂಜುನಾಥ"), ("Basappa", "ಬಸಪ್ಪ"), ("Krishnappa", "ಕೃಷ್ಣಪ್ಪ"), ("Muniyappa", "Muniappa"), ("Shankar", "Sankar"), ("Puttaswamy", "Puttaswami"), ("Laxmi", "Lakshmi"), ("Gowda", "Gauda"), ("Vijaya", "Vijay")]
APART = [("Ramesh", "Suresh"), ("Mohan", "Madan"), ("Kumar", "Kiran"), ("Ravi", "Raju"), ("Anil", "Sunil")]


def test_folding(spark):
    canon = lambda c: N.canonical(N.normalised(c))
    for pairs, same in ((ALIKE, True), (APART, False)):
        left, right = (_one(spark, [p[i] for p in pairs], canon) for i in (0, 1))
        assert [a == b for a, b in zip(left, right)] == [same] * len(pairs), list(zip(left, right))


def test_markers_initials_and_blank_names(spark):
    norm = _one(spark, ["Ramesh s/o Basappa alias Raju", "R.K.", "", "  ", "...", "@", "S/o", None, "ರಮೇಶ ಬಿನ್ ಬಸಪ್ಪ"], N.normalised)
    assert norm[0]["markers"] == ["alias"] and len(norm[0]["tokens"]) == 3
    assert norm[1]["tokens"] == [] and norm[1]["initials"] == ["k", "r"]
    assert all(n["tokens"] == [] and n["initials"] == [] for n in norm[2:8])
    assert norm[8]["script"] == "kannada" and norm[8]["markers"] == ["bin"]


def test_canonical_ignores_order_and_noise(spark):
    got = _one(spark, ["Ramesh Basappa", "basappa  RAMESH", "Basappa@Ramesh", "Sri Ramesh​ Basappa"], lambda c: N.canonical(N.normalised(c)))
    assert len(set(got)) == 1


def test_keys_of_renderings_meet(spark):
    keys = _one(spark, ["Ramesh Basappa", "ರಮೇಶ ಬಸಪ್ಪ", "Basappa R", "..."], lambda c: blocking.keys(N.normalised(c), F.lit(3)))
    assert set(keys[0]) & set(keys[1]) & set(keys[2]) and keys[3] == []
    whole = _one(spark, ["Ramesh Basappa"], lambda c: blocking.keys(N.normalised(c), families=("PH", "P4")))[0]
    assert {k[3:7] for k in whole if k.startswith("PH")} == {k[3:] for k in whole if k.startswith("P4")}


def test_phonetic_code(spark):
    assert _one(spark, ["Ashcraft", "Tymczak", "Pfister", "Honeyman", ""], N.phonetic_code) == ["A261", "T522", "P236", "H555", ""]


@pytest.mark.parametrize("a,b,want", [("", "", 0), ("", "a", 0), ("martha", "martha", 1), ("martha", "marhta", 0.961111), ("dwayne", "duane", 0.84), ("dixon", "dicksonx", 0.813333), ("abc", "xyz", 0)])
def test_jaro_winkler(a, b, want):
    assert jaro_winkler_of(a, b) == pytest.approx(want, abs=1e-6) and jaro_winkler_of(b, a) == pytest.approx(want, abs=1e-6)
