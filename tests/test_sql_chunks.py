from pairloom.functions import sql

CODE = "def f(a, b):\n" + "".join(f"    a = a + {i}\n" for i in range(40)) + "    return b"


def test_chunks_give_the_same_mutants(spark, monkeypatch):
    monkeypatch.setattr(sql, "CHUNK", 7)
    sql.register(spark)
    rows = [("long", CODE), ("none", "def g():\n    pass"), ("one", "def h(x):\n    return x"), ("null", None), ("broken", "def (")]
    spark.createDataFrame(rows, "name string, code string").createOrReplaceTempView("chunk_code")
    edits = "(SELECT *, mutation_edits(code) AS edits FROM chunk_code) f"
    whole = spark.sql(f"SELECT f.name, m.* FROM {edits}, LATERAL mutate_function(f.code, f.edits) m").collect()
    cut = spark.sql(
        f"SELECT f.name, m.* FROM {edits}, LATERAL mutation_chunks(f.code, f.edits) c, LATERAL mutate_chunk(f.code, c.start, c.part) m"
    ).collect()
    assert sorted(map(tuple, cut)) == sorted(map(tuple, whole))
    sizes = spark.sql(f"SELECT f.name, c.start, size(c.part) AS n FROM {edits}, LATERAL mutation_chunks(f.code, f.edits) c").collect()
    assert max(r.n for r in sizes) == 7 and len(sizes) > 20
    assert sum(r.n for r in sizes) == len(whole)
