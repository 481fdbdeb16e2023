"""The stored profile against the profile of all rows at once."""

from conftest import rows
from pyspark.sql import functions as F

from faturalens.plans import profile_store as store
from faturalens.plans.profile import data_profile, row_sums
from faturalens.sources import billing


def sections(df):
    return sorted((r["section"], r["key"], r["value"]) for r in df.collect() if r["value"] is not None)


def test_two_increments_equal_one_profile(spark, facts, tmp_path):
    folder, path = str(tmp_path / "facts"), str(tmp_path / "store")
    facts.where("year = 2025").coalesce(1).write.mode("append").parquet(folder)
    assert store.add_new_files(spark, folder, path, "1") == 1
    assert sections(store.stored_profile(spark, path)) == sections(data_profile(facts.where("year = 2025")))
    facts.where("coalesce(year <> 2025, true)").coalesce(1).write.mode("append").parquet(folder)
    # Were an earlier file read again, this would fail: its bytes are no table any more.
    for name in store.read_parts(spark, path, "files", "plain string").collect():
        open(name["plain"].removeprefix("file:"), "wb").write(b"PAR1 gone PAR1")
    assert len(store.new_files(spark, folder, path)) == 1
    assert store.add_new_files(spark, folder, path, "2", skip_unreadable=False) == 1
    assert sections(store.stored_profile(spark, path)) == sections(data_profile(facts))
    assert store.add_new_files(spark, folder, path, "3") == 0


def test_a_batch_added_twice_replaces_itself(spark, facts, tmp_path):
    path = str(tmp_path / "store")
    for _ in range(2):
        store.add_batch(facts, path, "a")
    assert sections(store.stored_profile(spark, path)) == sections(data_profile(facts))


def test_csv_files_and_an_empty_store(spark, facts, tmp_path):
    path, folder = str(tmp_path / "store"), tmp_path / "csv"
    assert sections(store.stored_profile(spark, path)) == sections(data_profile(facts.limit(0)))
    folder.mkdir()
    (folder / "a {1}.csv").write_text("Ano,Mês,NmCliente,VlrFaturamento\n2025,1,Alfa,10\n2025,x,Beta,2\n")
    (folder / "b.csv").write_text("NmCliente,Ano,VlrFaturamento\nAlfa,2026,5\n")
    assert store.add_new_files(spark, str(folder), path, "1", "csv") == 2
    want = data_profile(billing.read_billing(spark, str(folder), "csv"))
    assert sections(store.stored_profile(spark, path)) == sections(want)
    (folder / "c.csv").write_text("Ano,VlrFaturamento\n2027,7\n")
    assert store.add_new_files(spark, str(folder), path, "2", "csv") == 1
    total = store.stored_profile(spark, path).where("section = 'total' AND key IN ('soma', 'mediana')")
    assert sorted(rows(total.select("key", F.col("value")))) == [("mediana", 6.0), ("soma", 24.0)]


def test_parts_are_those_of_the_profile_and_batches_of_four_keys_count_too(spark, make_facts, tmp_path):
    rows_of = [(2025 + i % 2, 1 + i % 3, f"c{i % 7}" if i % 5 else None, f"p{i % 4}" if i % 3 else None, str(i)) for i in range(120)]
    first, second, path = make_facts(rows_of), make_facts(rows_of[:50] + [(None, None, None, None, None)]), str(tmp_path / "store")
    store.add_batch(first, path, "1")
    parts = store.read_parts(spark, path, "parts", store.PART_KIND)
    # One row per client, and per year, month and collaborator: not one per combination of all four.
    client = parts.where("_set = 14")
    assert client.count() == first.select("client").distinct().count()
    assert parts.count() == client.count() + first.select("year", "month", "collaborator").distinct().count()
    # A batch as it was written before: sums per all four keys.
    old = second.groupBy("year", "month", "client", "collaborator").agg(*[value.alias(name) for name, value in row_sums().items()])
    old.write.parquet(f"{path}/parts/batch=0")
    second.where("amount IS NOT NULL").groupBy("amount").agg(F.count(F.lit(1)).alias("n")).write.parquet(f"{path}/amounts/batch=0")
    assert sections(store.stored_profile(spark, path)) == sections(data_profile(first.unionByName(second)))


def test_columns_of_the_wanted_type_are_read_as_they_are(spark, facts, tmp_path):
    facts.coalesce(1).write.parquet(str(tmp_path / "a"))
    got = billing.read_billing(spark, str(tmp_path / "a"))
    assert sorted(map(str, rows(got))) == sorted(map(str, rows(facts)))
    assert "cast" not in got._jdf.queryExecution().optimizedPlan().toString().lower()
