import random
import time

from pyspark.sql import functions as F

from rolesieve.functions.text import contains_phrase, phrases_in

PHRASES = ["Python", "python", " C++ ", "c", "machine learning", "ss", "straße", "Σας", "İstanbul", "kit", "++", "a_b", "R&D", "node.js", "é", "日本 kit", "2d", "SQL Server 2019", ".net"]
ALPHABET = [*PHRASES, "C++x", "pythons", "ſs", "İstanbul kıt", "Kit", "KıT", "STRASSE", "STRAẞE", "σας", "ΣΑΣ", "a_b_c", "r&d", "NODE.JS", "nodexjs", "É", "日本", " ", "-", "\n", "_", "x", "learning", "Machine learning", "sql server 2019", "asp.net"]


def test_many_phrases_find_what_each_phrase_alone_finds(spark):
    rng = random.Random(11)
    texts = ["".join(rng.choice(ALPHABET) + rng.choice(["", " ", " ", ", "]) for _ in range(rng.randrange(9))) for _ in range(1500)]
    df = spark.createDataFrame([(t,) for t in [*texts, *ALPHABET, "", None]], "t string").repartition(4)
    alone = F.array_compact(F.array(*(F.when(contains_phrase("t", [p]), F.lit(p)) for p in PHRASES)))
    rows = df.select("t", alone.alias("want"), phrases_in("t", PHRASES).alias("got")).collect()
    assert [r for r in rows if r.want != r.got] == [] and {p for r in rows for p in r.got} == set(PHRASES)
    assert df.select(phrases_in("t", []).alias("g")).where("size(g) > 0").count() == 0


def test_cost_hardly_grows_with_the_number_of_phrases(spark):
    words = ["lorem", "ipsum", "dolor", "python", "sql", "a", "of", "the"]
    rng = random.Random(5)
    texts = [" ".join(rng.choices(words, k=400)) + f" w{i}" for i in range(2000)]
    df = spark.createDataFrame([(t,) for t in texts], "t string").repartition(4)
    df = df.union(df).union(df).cache()
    df.count()

    def seconds(n):
        phrases = [*words[:4], *(f"skill{i}" for i in range(n - 4))]
        took = []
        for _ in range(4):
            start = time.time()
            df.select(F.sum(F.size(phrases_in("t", phrases)))).collect()
            took.append(time.time() - start)
        return min(took)

    few, many = seconds(20), seconds(2000)
    print(few, many)
    assert many < 4 * few + 1
