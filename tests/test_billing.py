import random
import statistics
from decimal import Decimal

import pyarrow as pa
import pytest
from conftest import rows
from pyspark.sql import functions as F

from faturalens.operators import aggregates as agg, insight, selection as sel, trend
from faturalens.plans import profile as prof
from faturalens.plans.running import median, numbered, ranged, running_totals
from faturalens.sources import billing
from faturalens.sources.headers import first_line, header_lines, schema_groups


# --- sources ----------------------------------------------------------------------------
def test_headers_are_stripped_lowered_and_renamed(spark):
    df = spark.createDataFrame([(2025, 1, "x")], [" Ano ", "MÊS", "Outra"])
    assert billing.normalize_headers(df).columns == ["year", "month", "outra"]


def test_colliding_headers_are_refused(spark):
    df = spark.createDataFrame([(1, 2)], ["ano", " ANO"])
    with pytest.raises(ValueError, match="year"):
        billing.normalize_headers(df)


def test_folder_of_csv_with_differing_columns(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Ano,Mês,NmCliente,NmColaborador,VlrFaturamento\n2025,1,Alfa,Ana,10.5\n2025,2,Beta,Bia,20\n")
    (tmp_path / "fatura março {1}.csv").write_text("\nMês, ANO ,VlrFaturamento,NmCliente,Obs\n3,2026,30,Gama,x\n")
    (tmp_path / "empty.csv").write_text("")
    got = billing.read_billing(spark, str(tmp_path), "csv")
    assert got.columns == ["year", "month", "client", "collaborator", "amount", "obs"]
    assert rows(got.orderBy("month")) == [
        (2025, 1, "Alfa", "Ana", Decimal("10.5000"), None),
        (2025, 2, "Beta", "Bia", Decimal("20.0000"), None),
        (2026, 3, "Gama", None, Decimal("30.0000"), "x"),
    ]


def test_folder_of_parquet_with_differing_headers_and_types(spark, tmp_path):
    folder = str(tmp_path / "t")
    spark.sql("SELECT 2025 AS ` Ano `, 1 AS vlrfaturamento").coalesce(1).write.mode("append").parquet(folder)
    spark.sql("SELECT 2026L AS ano, 2.5D AS vlrfaturamento").coalesce(1).write.mode("append").parquet(folder)
    spark.sql("SELECT 2027 AS ano, 'Alfa' AS NmCliente").coalesce(1).write.mode("append").parquet(folder)
    (tmp_path / "t" / "broken.parquet").write_bytes(b"PAR1 this is no parquet file PAR1")
    got = billing.read_billing(spark, folder).orderBy("year")
    assert [(r.year, r.client, r.amount) for r in got.collect()] == [
        (2025, None, Decimal("1.0000")), (2026, None, Decimal("2.5000")), (2027, "Alfa", None),
    ]


def test_file_report_tells_paths_and_empty_files_apart(spark, tmp_path):
    folder = str(tmp_path / "t")
    spark.sql("SELECT 1 AS a, 2025 AS year UNION ALL SELECT 2, 2026 UNION ALL SELECT 3, 2026").coalesce(1).write.partitionBy("year").parquet(folder)
    got = {r.file_name.split("/")[0]: (r.rows_read, r.status) for r in billing.file_report(spark, folder).collect()}
    assert got == {"year=2025": (1, "read"), "year=2026": (2, "read")}
    other = tmp_path / "c"
    other.mkdir()
    (other / "fatura março 1+2.csv").write_text("a,b\n1,2\n")
    (other / "head.csv").write_text("a,b\n")
    got = {r.file_name: (r.rows_read, r.status) for r in billing.file_report(spark, str(other), "csv").collect()}
    assert got == {"fatura março 1+2.csv": (1, "read"), "head.csv": (0, "empty")}


def test_bad_cells_and_rows_cost_themselves_only(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Ano,Mês,NmCliente,VlrFaturamento,Obs\n2025,1,Alfa,10.5,x\nn/a,2,Beta,abc,y\n2025.0, ,Gama,1e2,\n")
    (tmp_path / "b.csv").write_text("Ano,Mês,NmCliente,VlrFaturamento,Obs\n2026,1\n2026,2,Beta,5,y,surplus\n2026,3.5,Beta,7,y\n")
    (tmp_path / "c.csv").write_text("Ano,Mês\n1,2,3\n")
    (tmp_path / "d.csv").write_text("Ano\n")
    folder = str(tmp_path)
    scan = billing.scan_billing(spark, folder, "csv")
    got = billing.good_rows(scan).orderBy("client", "year", "month")
    assert [(r.year, r.month, r.client, r.amount, r.obs) for r in got.collect()] == [
        (2025, 1, "Alfa", Decimal("10.5"), "x"), (None, 2, "Beta", None, "y"), (2026, None, "Beta", Decimal("7"), "y"), (2025, None, "Gama", Decimal("100"), None),
    ]
    found = billing.reject_rows(scan).collect()
    cells = sorted((r.file.split("/")[-1], r.column, r.value, r.reason) for r in found if r.column)
    assert cells == [("a.csv", "amount", "abc", "not of type decimal(18,4)"), ("a.csv", "year", "n/a", "not of type int"), ("b.csv", "month", "3.5", "not of type int")]
    lines = sorted((r.file.split("/")[-1], r.row) for r in found if r.column is None)
    assert lines == [("b.csv", "2026,1"), ("b.csv", "2026,2,Beta,5,y,surplus"), ("c.csv", "1,2,3")]
    report = {r.file_name: tuple(r)[1:] for r in billing.billing_report(spark, scan, folder, "csv").collect()}
    assert report == {"a.csv": (3, 0, 2, "read"), "b.csv": (1, 2, 1, "read"), "c.csv": (0, 1, 0, "rejected"), "d.csv": (0, 0, 0, "empty")}
    assert {r.file_name: (r.rows_read, r.status) for r in billing.file_report(spark, folder, "csv").collect()} == {
        "a.csv": (3, "read"), "b.csv": (1, "read"), "c.csv": (0, "empty"), "d.csv": (0, "empty"),
    }


def test_bad_values_in_typed_files(spark, tmp_path):
    folder = str(tmp_path / "t")
    spark.sql("SELECT 2025.5D AS ano, double('NaN') AS VlrFaturamento, 1 AS `mês` UNION ALL SELECT 2026D, 1e300D, 2").coalesce(1).write.parquet(folder)
    scan = billing.scan_billing(spark, folder)
    assert sorted(rows(billing.good_rows(scan).select("year", "month", "amount")), key=str) == [(2026, 2, None), (None, 1, None)]
    assert sorted((r.column, r.value) for r in billing.reject_rows(scan).collect()) == [("amount", "1.0E300"), ("year", "2025.5")]
    assert billing.read_billing(spark, folder).count() == 2
    lines = tmp_path / "j"
    lines.mkdir()
    (lines / "a.json").write_text('{"ano": 2025, "NmCliente": "Alfa"}\n{"ano": broken\n{"ano": "x", "NmCliente": "Beta"}\n')
    scan = billing.scan_billing(spark, str(lines), "json")
    assert sorted(rows(billing.good_rows(scan).select("year", "client")), key=str) == [(2025, "Alfa"), (None, "Beta")]
    assert sorted((r.column or "", r.value or "", r.row) for r in billing.reject_rows(scan).collect())[0] == ("", "", '{"ano": broken')


def test_one_column_twice_in_a_file_is_refused_but_not_across_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("ano,mês\n2024,1\n")
    (tmp_path / "b.csv").write_text(" Ano ,MÊS\n2025,2\n")
    assert sorted(rows(billing.read_billing(spark, str(tmp_path), "csv").select("year", "month"))) == [(2024, 1), (2025, 2)]
    (tmp_path / "c.csv").write_text("ano, Ano ,mês\n2024,2025,1\n")
    with pytest.raises(ValueError, match="'ano', ' Ano '"):
        billing.read_billing(spark, str(tmp_path), "csv")
    folder = str(tmp_path / "p")
    spark.sql("SELECT 2024 AS ano").coalesce(1).write.mode("append").parquet(folder)
    spark.sql("SELECT 2025 AS ` Ano `").coalesce(1).write.mode("append").parquet(folder)
    assert sorted(rows(billing.read_billing(spark, folder).select("year"))) == [(2024,), (2025,)]
    spark.sql("SELECT 1 AS ano, 2 AS ` Ano `").coalesce(1).write.mode("append").parquet(folder)
    with pytest.raises(Exception, match="' Ano '"):
        billing.read_billing(spark, folder).collect()


def test_headers_of_many_small_files_are_grouped(spark, tmp_path):
    for i in range(2000):
        head = ["ano,mês,NmCliente", "NmCliente,ano,mês"][i % 2]
        (tmp_path / f"f{i:04}.csv").write_text(f"{head}\n" + (f"{2000 + i},1,c\n" if i % 2 == 0 else f"c,{2000 + i},1\n"))
    found = header_lines(spark, str(tmp_path), "*.csv")
    assert sorted((r.header, r.files, len(r.paths)) for r in found.collect()) == [("NmCliente,ano,mês", 1000, 1000), ("ano,mês,NmCliente", 1000, 1000)]
    assert billing.read_billing(spark, str(tmp_path), "csv").agg(F.sum("year"), F.count("client")).first()[:] == (sum(range(2000, 4000)), 2000)


def test_only_the_head_of_a_large_file_is_read(spark, tmp_path):
    (tmp_path / "a.csv").write_text("ano,mês\n" + "2025,1\n" * 400_000)
    asked = []

    def counting(batches):
        def told(inner):
            for batch in inner:
                asked.append(batch.num_rows)
                yield batch

        yield from first_line(told(batches))

    batches = (pa.record_batch({"value": [f"line {i}"], "path": ["p"]}) for i in range(1000))
    assert sum(b.num_rows for b in counting(batches)) == 1 and sum(asked) <= 5
    assert [r.files for r in header_lines(spark, str(tmp_path), "*.csv").collect()] == [1]


def test_files_whose_schemas_clash_are_grouped(spark, tmp_path):
    folder = str(tmp_path / "t")
    for i in range(6):
        kind = "STRING" if i % 3 == 0 else "INT"
        spark.sql(f"SELECT CAST({2020 + i} AS {kind}) AS ano").coalesce(1).write.mode("append").parquet(folder)
    paths = [r["path"] for r in billing.list_files(spark, folder, "*.parquet").collect()]
    groups = schema_groups(spark, paths, "parquet", True)
    assert sorted(len(own) for _, own in groups) == [2, 4]
    assert sorted(r.year for r in billing.read_billing(spark, folder).collect()) == list(range(2020, 2026))


def test_folder_of_csv_beside_other_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Ano,Mês,NmCliente,VlrFaturamento\n2025,1,Alfa,10.5\n2025,2,Beta,20\n")
    (tmp_path / "notes.txt").write_text("not a table")
    df = billing.read_billing(spark, str(tmp_path), "csv")
    assert df.columns == ["year", "month", "client", "collaborator", "amount"]
    assert rows(df.orderBy("month")) == [
        (2025, 1, "Alfa", None, Decimal("10.5000")),
        (2025, 2, "Beta", None, Decimal("20.0000")),
    ]


def test_unreadable_parquet_is_skipped_and_reported(spark, tmp_path):
    folder = str(tmp_path / "t")
    spark.range(5).selectExpr("cast(id as int) as ano").coalesce(1).write.parquet(folder)
    (tmp_path / "t" / "broken.parquet").write_bytes(b"PAR1 this is no parquet file PAR1")
    assert billing.read_folder(spark, folder, schema="ano int").count() == 5
    report = {r.file_name: (r.rows_read, r.readable) for r in billing.file_report(spark, folder, schema="ano int").collect()}
    assert report.pop("broken.parquet") == (0, False)
    assert list(report.values()) == [(5, True)]


def test_union_fills_missing_columns(spark):
    a = spark.createDataFrame([(1, "x")], "year int, client string")
    b = spark.createDataFrame([(2.5, "k")], "year double, category string")
    both = billing.union_by_name(a, b)
    assert both.dtypes == [("year", "double"), ("client", "string"), ("category", "string")]
    assert sorted(rows(both), key=str) == [(1.0, "x", None), (2.5, None, "k")]


def test_no_rows_is_seen(facts):
    assert billing.has_rows(facts)
    assert not billing.has_rows(facts.where("year = 1900"))


def test_profile_of_nothing_has_its_zero_rows(spark, facts):
    got = {(r.section, r.key): r.value for r in prof.data_profile(facts.limit(0)).collect()}
    assert got[("total", "registros")] == got[("total", "soma")] == 0
    assert got[("identificados", "clientes")] == got[("identificados", "colaboradores")] == 0
    assert set(got) == {("total", k) for k in "registros minimo maximo soma media mediana".split()} | {("identificados", k) for k in ("clientes", "colaboradores")}


# --- selection --------------------------------------------------------------------------
def test_selection_without_lists_keeps_null_rows(facts):
    assert sel.select_facts(facts).count() == 8
    assert sel.select_facts(facts, years=[2025], months=[2]).count() == 2
    wanted = facts.select("client").where("client = 'Alfa'").distinct()
    assert sel.select_facts(facts, clients=wanted).count() == 3


def test_domains_drop_nulls_and_sort(facts):
    assert rows(sel.domain(facts, "year")) == [(2025,), (2026,)]
    assert rows(sel.domain(facts, "client")) == [("Alfa",), ("Beta",), ("Gama",), ("Nula",)]


# --- aggregates -------------------------------------------------------------------------
def test_null_keys_are_left_out_and_all_null_group_is_zero(facts):
    got = {(r.year, r.month): r.revenue for r in agg.monthly_revenue(facts).collect()}
    assert got == {(2025, 1): 100, (2025, 2): 120, (2025, 4): 110, (2026, 1): 150, (2026, 2): 0}


def test_ranking_breaks_ties_by_name(make_facts):
    tied = make_facts([(2025, 1, c, "p", "5") for c in "BAC"] + [(2025, 1, "Z", "p", "9")])
    assert [r.client for r in agg.ranking(tied).collect()] == ["Z", "A", "B", "C"]


def test_pivot_leaves_missing_months_null(facts):
    got = rows(agg.month_year_pivot(facts, [2025, 2026]))
    assert got == [(1, 100, 150), (2, 120, 0), (4, 110, None)]


def test_indicators(facts):
    assert rows(agg.indicators(facts)) == [(490.5, 96.0, "Alfa")]
    assert rows(agg.indicators(facts.where("year = 1900"))) == [(0.0, None, "-")]
    assert rows(agg.top_client(facts.where("year = 1900"))) == [("-",)]


def test_counts(facts):
    assert rows(agg.distinct_counts(facts)) == [(4, 4)]
    assert rows(agg.record_count(facts)) == [(8,)]
    active = {(r.year, r.month): r.collaborators for r in agg.active_collaborators(facts).collect()}
    assert active[(2025, 2)] == 1


def test_amount_profile_skips_nulls(facts):
    row = agg.amount_profile(facts).first()
    assert (float(row.min_amount), float(row.max_amount), row.median_amount) == (3.5, 150.0, 105.0)
    assert row.mean_amount == pytest.approx(490.5 / 6)


# --- running totals ---------------------------------------------------------------------
@pytest.mark.parametrize("seed", [1, 2, 3])
def test_median_against_brute_force_with_a_hot_value(spark, seed):
    rng = random.Random(seed)
    values = [rng.randrange(-5000, 5000) for _ in range(4000 + seed)] + [7] * 2000
    df = spark.createDataFrame([(v,) for v in values], "v int")
    assert median(df, "v").first()[0] == statistics.median(values)


def test_median_of_one_and_of_none(spark):
    one = spark.createDataFrame([(5,), (None,)], "v int")
    assert median(one, "v").first()[0] == 5.0
    assert median(one.where("v is null"), "v").first()[0] is None


def test_ranges_follow_the_cluster_and_the_rows(spark):
    """More shuffle partitions give more and smaller ranges, though most keys lie close together."""
    keys = spark.range(4000).selectExpr("CASE WHEN id < 3900 THEN id / 1e6 ELSE id END AS k", "1 AS m")
    kept = {name: spark.conf.get(name) for name in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        for parts in (4, 40):
            spark.conf.set("spark.sql.shuffle.partitions", str(parts))
            sizes = [r["count"] for r in ranged(keys, "k").groupBy("_part").count().collect()]
            assert len(sizes) >= parts * 0.9 and max(sizes) <= 2.5 * 4000 / parts
            assert {r.cum_m for r in running_totals(keys, "k", ["m"]).collect()} == set(range(1, 4001))
    finally:
        for name, value in kept.items():
            spark.conf.set(name, value)


def test_places_in_groups_against_sorting(spark):
    source = random.Random(7)
    data = [(source.choice(["a", "hot", "hot", "hot", "z"]), source.choice([None, *range(40)]), i) for i in range(700)]
    got = numbered(spark.createDataFrame(data, "g string, v int, id int").repartition(5), ["g"], ["v", "id"]).collect()
    want = {}
    for g in {row[0] for row in data}:
        own = sorted((row for row in data if row[0] == g), key=lambda row: (row[1] is not None, row[1] or 0, row[2]))
        want.update({row[2]: (place, len(own)) for place, row in enumerate(own)})
    assert {r["id"]: (r["_place"], r["_count"]) for r in got} == want
    whole = numbered(spark.range(50).selectExpr("id * 7 % 50 AS v"), [], ["v"]).collect()
    assert sorted((r["v"], r["_place"]) for r in whole) == [(i, i) for i in range(50)]
    assert numbered(spark.range(0), [], ["id"]).collect() == []


@pytest.mark.parametrize("descending", [False, True])
def test_running_totals_against_brute_force(spark, descending):
    rng = random.Random(9)
    data = {k: rng.randrange(100) for k in rng.sample(range(100000), 5000)}
    df = spark.createDataFrame(list(data.items()), "k int, m bigint").repartition(7)
    got = {r.k: r.cum_m for r in running_totals(df, "k", ["m"], descending).collect()}
    total, want = 0, {}
    for k in sorted(data, reverse=descending):
        total += data[k]
        want[k] = total
    assert got == want


# --- trend --------------------------------------------------------------------------------
def test_trend_case(make_facts):
    # A gap in the months does not leave a gap in t.
    amounts = [(2025, 1, "100"), (2025, 2, "120"), (2025, 5, "110"), (2026, 1, "150")]
    series = trend.monthly_series(make_facts([(y, m, "c", "p", a) for y, m, a in amounts]))
    model = trend.trend_model(series).first()
    assert (model.n, round(model.slope, 6), round(model.intercept, 6)) == (4, 14, 99)
    got = [(r.t, round(r.forecast, 6)) for r in trend.forecast(series).orderBy("t").collect()]
    assert got == [(4, 155), (5, 169), (6, 183), (7, 197), (8, 211), (9, 225)]
    assert [round(r.forecast, 6) for r in trend.fitted(series).orderBy("t").collect()] == [99, 113, 127, 141]


def test_single_month_is_flat(make_facts):
    series = trend.monthly_series(make_facts([(2025, 1, "c", "p", "100")]))
    model = trend.trend_model(series).first()
    assert (model.slope, model.intercept) == (0, 100)
    assert {r.forecast for r in trend.forecast(series).collect()} == {100.0}


def test_projection(make_facts):
    series = trend.monthly_series(make_facts([(2025, m, "c", "p", "100") for m in range(1, 11)]))
    row = trend.year_projection(series).first()
    assert (row.months_projected, row.observed, round(row.realistic, 6)) == (2, 1000.0, 1200.0)
    assert round(row.aggressive - row.conservative, 6) == 0


# --- insight --------------------------------------------------------------------------------
def test_year_on_year_needs_the_year_before(make_facts):
    df = make_facts([(2023, 1, "c", "p", "50"), (2025, 1, "c", "p", "100"), (2026, 1, "c", "p", "150"), (2026, 2, "c", "p", "9")])
    got = {(r.year, r.month): r.yoy_pct for r in insight.year_on_year(df).collect()}
    assert got == {(2023, 1): None, (2025, 1): None, (2026, 1): 50.0, (2026, 2): None}
    annual = {r.year: (r.total_pct, r.shared_months, r.shared_pct) for r in insight.annual_change(df).collect()}
    assert annual[2026] == (pytest.approx(59.0), 1, 50.0)
    assert annual[2025] == (None, 0, None)


def test_zero_before_gives_no_change(make_facts):
    df = make_facts([(2025, 1, "c", "p", "0"), (2026, 1, "c", "p", "5"), (2026, 2, "c", "p", "5")])
    assert {r.yoy_pct for r in insight.year_on_year(df).collect()} == {None}


def test_concentration_counts_rows_without_client_in_the_total(make_facts):
    df = make_facts([(2025, 1, "A", "p", "30"), (2025, 1, "B", "p", "20"), (2025, 1, None, "p", "50")])
    row = insight.concentration(df).first()
    assert (row.top1_pct, row.top3_pct) == (30.0, 50.0)
    assert insight.risk_level(df).first().risk == "Moderado"


def test_people_for_share_with_ties(make_facts):
    df = make_facts([(2025, 1, "c", f"p{i}", "10") for i in range(10)])
    assert rows(insight.people_for_share(df)) == [(10, 8)]
    shares = {r.cumulative_pct for r in insight.cumulative_share(df).collect()}
    assert shares == {100.0}
    skewed = make_facts([(2025, 1, "c", "hot", "900")] + [(2025, 1, "c", f"p{i}", "10") for i in range(10)])
    assert rows(insight.people_for_share(skewed)) == [(11, 1)]


def test_load_and_exit(make_facts):
    df = make_facts([(2025, 1, "c", "a", "10")] * 6 + [(2025, 1, "c", "b", "10")] * 2 + [(2025, 1, "c", None, "20")])
    got = {r.collaborator: (r.records_ratio, r.load) for r in insight.collaborator_load(df).collect()}
    assert got == {"a": (1.5, "normal"), "b": (0.5, "normal")}
    impact = {r.collaborator: r.impact_pct for r in insight.exit_impact(df).collect()}
    assert impact == {"a": 60.0, "b": 20.0}


# --- profile ----------------------------------------------------------------------------------
def test_profile_with_null_keys(facts):
    got = {(r.section, r.key): r.value for r in prof.data_profile(facts).collect()}
    assert got[("total", "registros")] == 8
    assert got[("total", "soma")] == 490.5
    assert got[("total", "mediana")] == 105
    assert got[("registros", "2025-02")] == 2
    assert got[("ativos", "2025-02")] == 1
    assert got[("faturamento_ano", "2026")] == 153.5
    assert got[("identificados", "clientes")] == 4
    assert got[("clientes", "Nula")] == 0
    assert ("registros", "2026-02") in got
    assert not any(key is None for _, key in got)


def test_profile_parts_share_their_shuffles(facts, spark, tmp_path):
    """One pass for all sums; the parts reuse its shuffles. The median's running counts are a written table."""
    path = str(tmp_path / "facts")
    facts.write.parquet(path)
    df = prof.data_profile(spark.read.parquet(path))
    df.collect()
    assert df._jdf.queryExecution().executedPlan().toString().count("ReusedExchange") >= 2


def test_profile_lines_name_every_client_once(facts):
    lines = [r.line for r in prof.profile_lines(prof.data_profile(facts)).orderBy("part", "rank", "place").collect()]
    assert lines[:3] == ["### Período", "- Anos: [2025, 2026]", "- Meses: [1, 2, 4]"]
    assert lines[3] == "### Clientes (4 identificados)"
    assert lines[4:8] == ["- Alfa", "- Beta", "- Gama", "- Nula"]
    assert "- soma R$ 490.50" in lines


def test_template_without_marker_fails(facts):
    filled = prof.prompt_by_key(F.lit("x {dados}"), "{dados}", facts, "client")
    assert {r.client: r.prompt for r in filled.collect()}["Gama"] == "x 2026-01 R$ 150.00"
    with pytest.raises(Exception, match="marker"):
        prof.prompt_by_key(F.lit("no marker"), "{dados}", facts, "client").collect()
