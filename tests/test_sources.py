import pytest
from pyspark.sql import functions as F

from tests.helpers import CONTACT_SCHEMA, example_contacts
from weftspan.operators import compare, features, graph, islands, viewdata
from weftspan.plans import cli
from weftspan.plans.pipeline import StripeCaller
from weftspan.sources import bedpe, catalog, dialects
from weftspan.streaming import ingest

BODY = "chr1\t10\t20\tchr1\t50\t60\nchr1\t11\t21\tchr2\t51\t61"


def write(path, text):
    path.write_text(text)
    return str(path)


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def test_headers_and_counts(spark, tmp_path):
    plain = bedpe.read_contacts(spark, write(tmp_path / "a", BODY))
    assert plain.columns == list(bedpe.CORE) and plain.count() == 2
    named = write(tmp_path / "b", "chr1\tstart1\tend1\tchr2\tstart2\tend2\tcount\n1\t10\t20\t1\t50\t60\t7\n2\t1\t2\t2\t3\t4\t1")
    assert rows_of(bedpe.read_contacts(spark, named)) == [("chr1", 10, 20, "chr1", 50, 60, 7), ("chr2", 1, 2, "chr2", 3, 4, 1)]
    assert bedpe.read_contacts(spark, named, min_petcount=5).count() == 1
    comment = write(tmp_path / "c", "#c\ts\te\tc\ts\te\tnumColapsed\nchr1\t1\t2\tchr1\t3\t4\t9 # late\n\n")
    assert rows_of(bedpe.read_contacts(spark, comment))[0][:6] == ("chr1", 1, 2, "chr1", 3, 4)
    mixed = write(tmp_path / "d", "chr1\t1\t2\t2\t3\t4")
    assert rows_of(bedpe.read_contacts(spark, mixed)) == [("chrchr1", 1, 2, "chr2", 3, 4)]
    assert rows_of(bedpe.read_contacts(spark, mixed, fix_chromosome=False)) == [("chr1", 1, 2, "2", 3, 4)]
    with pytest.raises(ValueError, match="at least 3"):
        bedpe.read_contacts(spark, write(tmp_path / "e", "chr1\t5"))
    late = write(tmp_path / "g", "# c\n" * 1500 + "a\tstart\tend\tb\tstart\tend\n" + BODY)
    assert bedpe.read_contacts(spark, late).count() == 2
    assert rows_of(bedpe.read_contacts(spark, mixed, prefixed=True)) == [("chr1", 1, 2, "2", 3, 4)]
    assert bedpe.read_contacts(spark, write(tmp_path / "h", "")).count() == 0
    skipped = write(tmp_path / "f", "junk line\n" + BODY)
    assert bedpe.read_contacts(spark, skipped, skiprows=1).count() == 2


def test_extras_and_filters(spark, tmp_path):
    path = write(tmp_path / "a", "chr1\t1\t2\tchr1\t3\t4\tx\t0.5\nchr1\t1\t2\tchr2\t3\t4\ty\t0.25\nchr3\t1\t2\tchr3\t3\t4\tz\t1")
    got = bedpe.read_contacts(spark, path, (7, "score", "double"), (6, "name", "string"))
    assert {(r.name, r.score) for r in got.collect()} == {("x", 0.5), ("y", 0.25), ("z", 1.0)}
    with pytest.raises(ValueError, match="taken"):
        bedpe.read_contacts(spark, path, (7, "a", "string"), (7, "b", "string"))
    count = lambda **k: bedpe.read_contacts(spark, path, **k).count()
    assert (count(intrachromosomal=False), count(interchromosomal=False), count(chromosomes="chr2"), count(chromosomes=["chr1"]), count(chromosomes=["chr1", "chr2"]), count(nrows=1)) == (1, 2, 1, 1, 2, 1)


def test_command_line_and_dialects(spark, tmp_path):
    lines = ["\t".join(CONTACT_SCHEMA.replace(" string", "").replace(" long", "").split(", ")), *("\t".join(map(str, r)) for r in example_contacts())]
    source = write(tmp_path / "example.bedpe", "\n".join(lines))
    out = cli.main([source, str(tmp_path / "out"), "--quiet", "--stats"])
    table = spark.read.csv(out, sep="\t", header=True, inferSchema=True)
    assert table.count() == 2 and {r.direction for r in table.collect()} == {"L", "R"}
    stats = spark.read.csv(str(tmp_path / "out/example.stats.tsv"), sep="\t", header=True)
    assert stats.count() == len(cli.FEATURES) and stats.columns == ["feature", "count", "mean", "std", "min", "p1", "p5", "p25", "p50", "p75", "p95", "p99", "max"]
    bins = spark.read.csv(str(tmp_path / "out/example.histograms.tsv"), sep="\t", header=True, inferSchema=True)
    assert bins.groupBy("feature").sum("n").count() == len(cli.FEATURES) and bins.agg(F.max("bin")).first()[0] == 49
    assert cli.main([source, str(tmp_path / "named"), "-n", "mine", "-v", "-l", "ERROR"]).endswith("mine.stripes.tsv")
    dialects.save_viewer_stripes(table, str(tmp_path / "viewer"), pad_w=5, pad_l=7)
    right = next(r for r in dialects.viewer_rows(table, pad_w=5, pad_l=7).collect() if r.direction == "R")
    assert (right.chr, right.pos1, right.pos2, right.pos3, right.pos4) == ("20", 10001 - 5 - 1, 25001 + 5, 10001 - 7, 105001 + 5)
    back = dialects.read_viewer_stripes(spark, str(tmp_path / "viewer"))
    assert {(r.chromosome, r.direction) for r in back.collect()} == {("chr20", "L"), ("chr20", "R")}
    assert [r.stripe_id for r in dialects.read_viewer_positions(spark, str(tmp_path / "viewer")).collect()] == [0, 1]
    dialects.save_domains(table, str(tmp_path / "bed"))
    assert spark.read.csv(str(tmp_path / "bed"), sep="\t").count() == 2
    third = write(tmp_path / "third", "chr\tpos1\tpos2\tchr2\tpos3\tpos4\tlength\twidth\n2\t100\t110\t2\t10\t110\t100\t10\n1\t5\t9\t1\t5\t90\t85\t4")
    assert [(r.stripe_id, r.chr, r.direction) for r in dialects.read_third_party(spark, third).orderBy("stripe_id").collect()] == [(0, "chr1", "R"), (1, "chr2", "L")]
    args = cli.parser().parse_args(["x", "y", "--no-fix-bin-start", "--data-bin-size", "100"])
    assert cli.params_of(args).fix_bin_start is False and cli.params_of(args).data_bin_size == 100


def test_catalog(spark, tmp_path):
    for name in ("runs/a_1.csv", "runs/a_2.csv", "runs/b_1.csv", "masks/1.bed"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text("v,w\n1,2\n")
    c = catalog.Catalog(spark, str(tmp_path), ["sample", "rep"])
    c.add("runs", r"(?P<sample>\w)_(?P<rep>\d+)\.csv", "runs", types={"rep": "int"}).add("masks", r"(?P<rep>\d+)\.bed", types={"rep": "int"}, defaults={"sample": "a"})
    assert rows_of(c.paths("runs").select("sample", "rep")) == [("a", 1), ("a", 2), ("b", 1)]
    assert [(r.sample, r.rep, bool(r.runs), bool(r.masks)) for r in c.table().collect()] == [("a", 1, True, True), ("a", 2, True, False), ("b", 1, True, False)]
    assert c.paths("runs", limit_per_source=1).count() == 1
    whole = catalog.read_and_concat(spark, c.paths("runs"), ["sample", "rep"], lambda s, p: s.read.csv(p, header=True), row_number="row")
    assert sorted(r.row for r in whole.collect()) == [0, 1, 2] and set(whole.columns) == {"v", "w", "sample", "rep", "row"}
    with pytest.raises(KeyError):
        c.paths("none")


def test_split_write(spark, tmp_path):
    import re

    rows = [("a-b_c", -1, 1.5), ("c", 2, 2.5), ("x y/z+%\u00fc", 0, 1e10), (None, 7, 0.25), ("c", 2, 3.5), ("gone", 5, 0.5)]
    df = spark.createDataFrame(rows, "name string, n int, v double")
    root, pattern, kinds = catalog.split_write(df, f"{tmp_path}/out/run_", ["name", "n"], suffix=".csv", format="csv", header=True, fix=lambda d: d.filter("coalesce(name, '') <> 'gone'"))
    assert (root, kinds) == (f"{tmp_path}/out", ("string", "int"))
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == sorted(["run_a-b%5Fc_-1.csv", "run_c_2.csv", "run_x+y%2Fz%2B%25%C3%BC_0.csv", "run___HIVE_DEFAULT_PARTITION___7.csv", "run_gone_5.csv"])
    (tmp_path / "out/run_c_2.csv.other").mkdir()
    (tmp_path / "out/run_c_2.csv.other/part-0").write_text("v")
    c = catalog.Catalog(spark, root, ["name", "n"]).add("runs", pattern, types={"n": "int"}, encoded=True)
    assert {(r["name"], r.n) for r in c.paths("runs").collect()} == {r[:2] for r in rows}
    assert all(re.search(pattern, r.path) for r in c.paths("runs").collect())
    back = catalog.read_and_concat(spark, c.paths("runs"), ["name", "n"], lambda s, p: s.read.csv(p, header=True, schema="v double"), row_number="row")
    assert {(r["name"], r.n, r.v) for r in back.collect()} == set(rows[:-1]) and sorted(r.row for r in back.collect()) == [0, 1, 2, 3, 4]
    seen = []
    catalog.split_write(df, f"{tmp_path}/two/", ["v"], write=lambda w, p: seen.append(p) or w.json(p), skip_empty=True)
    assert len(seen) == 1 and sorted(p.name for p in (tmp_path / "two").iterdir()) == ["0.25", "0.5", "1.0E10", "1.5", "2.5", "3.5"]
    double = re.compile(catalog.restore_pattern({"v": "double"}, "", "_", ""))
    assert all(double.fullmatch(f"{x}/part-0") for x in ("0.5", "1.0E10", "-1.0E-5", "NaN", "-Infinity")) and not double.fullmatch("x/part-0")


def test_catalog_keys_of_a_path_and_overlapping_sources(spark, tmp_path, caplog):
    (tmp_path / "a_1.csv").write_text("v\n1\n")
    (tmp_path / "b_2.csv").write_text("w,v\n5,6\n")
    c = catalog.Catalog(spark, str(tmp_path), ["sample", "rep"]).add("runs", r"(?P<sample>\w)_(?P<rep>\d+)\.csv", types={"rep": "int"}).add("runs", r"(?P<sample>a)_1\.csv", defaults={"rep": 9}, types={"rep": "int"})
    assert c.keys_of("runs", "/else/where/q_77.csv") == {"sample": "q", "rep": 77} and c.keys_of("runs", "/x.txt") is None
    with caplog.at_level("WARNING"):
        assert c.paths("runs").count() == 3
    assert any("several sources" in m and "a_1.csv" in m for m in caplog.messages)
    unlike = catalog.read_and_concat(spark, c.paths("runs").filter("rep < 9"), ["sample"], lambda s, p: s.read.csv(p, header=True), alike=False)
    assert {(r.sample, r.v, r.w) for r in unlike.collect()} == {("a", "1", None), ("b", "6", "5")}


def test_streamed_edges_equal_the_batch(spark, tmp_path):
    rows = [(*r, 2) for r in example_contacts()]
    for i, part in enumerate((rows[:6], rows[6:])):
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / f"in/{i}.tsv").write_text("\n".join("\t".join(map(str, r)) for r in part))
    stream = ingest.stream_contacts(spark, str(tmp_path / "in"), max_files=1)
    ingest.maintain(stream, str(tmp_path / "pairs"), str(tmp_path / "state")).awaitTermination()
    batch = ingest.bin_pairs(spark.createDataFrame(rows, ingest.SCHEMA))
    order = batch.columns
    assert rows_of(ingest.current_pairs(spark, str(tmp_path / "pairs")).select(*order)) == rows_of(batch)


def test_views(spark):
    points = spark.createDataFrame([(10, 90), (90, 10), (50, 50), (500, 1)], "x long, y long")
    view = viewdata.View((0, 100), (0, 100), 10)
    assert rows_of(viewdata.points(points, view, "upper").select("x", "y")) == [(50, 50), (90, 10), (90, 10)]
    assert rows_of(viewdata.points(points, view, "lower").select("x", "y")) == [(10, 90), (10, 90), (50, 50)]
    assert viewdata.points(points, view, "both").count() == 6
    with pytest.raises(ValueError):
        viewdata.points(points, view, "middle")
    assert (view.unit(), viewdata.View((0, 2 * 10**5), (0, 1)).unit(), viewdata.View((0, 10**7), (0, 1)).unit()) == (("bp", 1), ("kb", 1000), ("mb", 10**6))
    call = StripeCaller().start(spark.createDataFrame(example_contacts(), CONTACT_SCHEMA))
    whole = viewdata.View((0, 200000), (0, 200000), 5000, "chr20", "chr20")
    raw, scored = call.raw, call.scored
    assert viewdata.stripe_rectangles(raw, whole, "both", 5, 7).count() == 12
    assert viewdata.loop_cluster_rectangles(scored, raw, whole, "asis").count() == 10
    segments = {(r.stripe_id, r.lc_idx): (r.x0, r.y0, r.x1, r.y1) for r in viewdata.gap_segments(scored, raw, whole).collect()}
    assert segments[0, 0] == (17501, 17501, 20001, 17501) and segments[0, 1] == (35001, 17501, 50001, 17501)
    assert len(viewdata.gap_segments(scored, raw, whole, "lower").collect()) == len(segments)
    label = next(r for r in viewdata.stripe_labels(scored, raw).collect() if r.stripe_id == 0)
    assert label.label == "0(0.82|0.55|100.00|1.0)" and (label.x, label.y) == (105001, 17501)
    matrix = viewdata.contact_matrix(spark.createDataFrame(example_contacts(), CONTACT_SCHEMA).withColumn("petcount", F.lit(1)), whole)
    assert matrix.agg(F.sum("value")).first()[0] == 12 and viewdata.colour_limit(matrix).first()[0] >= 1
    assert viewdata.stripe_counts(raw).agg(F.sum("n")).first()[0] == 8
    assert features.describe(scored, ["length"]).first()["count"] == 12


def test_comparison_of_datasets(spark):
    raw = StripeCaller().start(spark.createDataFrame(example_contacts(), CONTACT_SCHEMA)).raw
    sets = raw.withColumn("run", F.lit("x")).unionByName(raw.filter("stripe_id < 3").withColumn("run", F.lit("y")))
    pairs, counts = compare.compare_stripes(sets, by=["run"], on=[])
    table = {(r.run_A, r.run_B): (r.m_A, r.n_A, r.p_A) for r in counts.collect()}
    assert table["x", "x"] == (8, 8, 1.0) and table["x", "y"][0] == 3 and table["y", "y"] == (3, 3, 1.0)
    pivot = {r.run_A: (r.x, r.y) for r in compare.mapping_table(counts, ["run"], []).collect()}
    assert pivot == {"x": (8, 3), "y": (3, 3)}
    percent = {(r.run_A, r.run_B): r.label for r in compare.mapping_percentages(counts, ["run"], []).collect()}
    assert percent["x", "y"] == "38" and percent["x", "x"] == "8"
    _, domains = compare.compare_domains(sets, by=["run"], on=[])
    assert domains.count() == 4
    assert compare.collapse_labels(counts, ["run"]).columns[-2:] == ["dataset_A", "dataset_B"]


def test_node_strategies_and_user_aggregates(spark):
    rows = graph.prepare(spark.createDataFrame(example_contacts(), CONTACT_SCHEMA))
    found = graph.anchors(rows, numbered=True)
    assert found.filter("graph = 'chr20'").count() == 7 and {r.anchor_id for r in found.filter("graph = 'chr21'").collect()} == {0, 1, 2}
    wide = graph.nodes(graph.assign_nodes(found, graph.cluster_overlapping(2501)))  # reaches over gaps of one bin
    assert sorted(r.n_anchors for r in wide.filter("graph = 'chr20'").collect()) == [1, 1, 2, 3]
    assert graph.nodes(graph.assign_nodes(found, graph.one_node_each)).count() == 10
    assert graph.nodes(graph.assign_nodes(found, graph.cluster_overlapping(6000, from_midpoint=True))).filter("graph = 'chr20'").count() == 4
    nodes, edges = graph.build(rows, node_aggs={"widest": F.max("length")}, edge_aggs={"mean": F.avg("petcount")})
    assert "widest" in nodes.columns and {r["mean"] for r in edges.collect()} == {1.0}
    assert graph.strand_edges(nodes).count() == 8


def test_ids_count_rows_over_files(spark, tmp_path):
    """Ids are row numbers from 0 in the order of the files, however they are read."""
    lines = ["chr\tpos1\tpos2\tchr2\tpos3\tpos4\tcolor"] + [f"{1 + i % 3}\t{i * 10}\t{i * 10 + 5}\t{1 + i % 3}\t{i * 10}\t{i * 10 + 90}\tx" for i in range(400)]
    for k in range(3):
        (tmp_path / f"f{k}.tsv").write_text("\n".join([lines[0], *lines[1 + k * 100 : 101 + k * 100 + (100 if k == 2 else 0)]]) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "900")
    spark.conf.set("spark.sql.files.openCostInBytes", "10")
    got = dialects.read_viewer_stripes(spark, str(tmp_path)).collect()
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")
    assert sorted((r.stripe_id, r.anchor_start) for r in got) == [(i, i * 10) for i in range(400)]
    natural = dialects.read_viewer_positions(spark, str(tmp_path)).orderBy("stripe_id").collect()
    assert [(r.chr, r.pos1) for r in natural] == sorted(((f"chr{1 + i % 3}", i * 10) for i in range(400)))


def test_keys_of_a_table_of_paths(spark, tmp_path):
    c = catalog.Catalog(spark, str(tmp_path), ["sample", "rep"]).add("runs", r"(?P<sample>[a-z]+)_(?P<rep>\d+)\.csv", types={"rep": "int"}).add("runs", r"(?P<sample>[a-z]+)\.csv", defaults={"rep": 0}, types={"rep": "int"})
    paths = spark.createDataFrame([("/x/q_7.csv",), ("/x/q_7.csv",), ("/y/z.csv",), ("/no.txt",)], "path string")
    got = {r.path: (r["sample"], r.rep) for r in c.keys_of_all("runs", paths).collect()}
    assert got == {"/no.txt": (None, None), "/x/q_7.csv": ("q", 7), "/y/z.csv": ("z", 0)}


def test_split_tables_are_replaced_whole(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v long")
    for _ in range(2):
        root, _, _ = catalog.split_write(df, f"{tmp_path}/t_", ["k"], format="parquet")
    assert sorted(p.name for p in tmp_path.iterdir()) == ["t_a", "t_b"]
    assert [r.v for r in spark.read.parquet(f"{root}/t_a").collect()] == [1]


def test_records_of_a_table(spark):
    df = spark.sql("select * from values (named_struct('a', 'x', 'b', 3, 'c', 5)), (null) as t(record)")
    assert [tuple(r) for r in islands.from_records(df, "record", ["name"]).collect()] == [("x", 3, 5)]
    with pytest.raises(ValueError, match="3 values"):
        islands.from_records(df.selectExpr("struct(1, 2) as record"), "record", ["name"])
    with pytest.raises(Exception, match="before it starts"):
        islands.from_records(df.selectExpr("struct(5, 2) as record"), "record").collect()
