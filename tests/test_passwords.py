"""bcrypt against public vectors."""

import pytest
from pyspark.sql import functions as F

from caseloom.functions import passwords

#: From the public test vectors of crypt_blowfish.
VECTORS = [
    ("U*U", "$2a$05$CCCCCCCCCCCCCCCCCCCCC.E5YPO9kmyuRGyh0XouQYb4YMJKvyOeW"),
    ("U*U*", "$2a$05$CCCCCCCCCCCCCCCCCCCCC.VGOzA784oUp/Z0DY336zx7pLYAy0lwK"),
    ("U*U*U", "$2a$05$XXXXXXXXXXXXXXXXXXXXXOAcXxm9kjPGEMsLznoKqmqw7tc8WCx4a"),
]


def test_tables_are_the_bits_of_pi():
    words = passwords.pi_words()
    assert [hex(w) for w in words[:4]] == ["0x243f6a88", "0x85a308d3", "0x13198a2e", "0x3707344"] and hex(words[-1]) == "0x3ac372e6" and len(words) == 18 + 1024


def test_alphabet_round_trip():
    assert passwords.decode64(passwords.encode64(bytes(range(16)))) == bytes(range(16)) and len(passwords.encode64(bytes(23))) == 31


def test_public_vectors_and_odd_rows(spark):
    rows = [(*v, True) for v in VECTORS] + [("U*u", VECTORS[0][1], False), (None, VECTORS[0][1], False), ("U*U", None, False), ("U*U", "", False), ("U*U", "$2x" + VECTORS[0][1][3:], False), ("U*U", VECTORS[0][1][:-1], False), ("U*U", "$2a$99" + VECTORS[0][1][6:], False)]
    df = spark.createDataFrame(rows, "p string, h string, want boolean").coalesce(1)
    assert all(r.matches == r.want for r in passwords.matches(df, "p", "h").collect())
    assert passwords.matches(df.limit(0), "p", "h").collect() == []


def test_made_hashes_match(spark):
    long = "é" * 40
    df = spark.createDataFrame([(0, "one"), (1, ""), (2, None), (3, long), (4, long + "more")], "id long, p string").coalesce(1)
    made = passwords.hashes(df, "p", passwords.random_salt(), cost=4).checkpoint()
    got = {r.id: r for r in made.collect()}
    assert got[2].hash is None and all(got[i].hash.startswith("$2b$04$") for i in (0, 1, 3, 4)) and len({got[i].hash[7:29] for i in (0, 1, 3, 4)}) == 4
    # only 72 bytes count
    tried = made.withColumn("q", F.when(F.col("id") == 3, F.lit(long[:36] + "other")).when(F.col("id") == 1, "x").otherwise(F.col("p")))
    assert {r.id: r.matches for r in passwords.matches(tried.coalesce(1), "q", "hash").collect()} == {0: True, 1: False, 2: False, 3: True, 4: True}
    with pytest.raises(ValueError):
        passwords.hashes(df, "p", passwords.random_salt(), cost=3)
