"""The data source of interaction files, against plain Python on the same files."""

import gzip

import pytest

from weftspan.sources import bedpe, bedpe_files


def line(i, prefix="chr", tail=""):
    return f"{prefix}{1 + i % 3}\t{i * 10}\t{i * 10 + 5}\t{prefix}{1 + i % 2}\t{i * 20}\t{i * 20 + 7}{tail}\n"


@pytest.fixture
def files(tmp_path):
    """Four files with unlike heads: names, comments, skipped rows, nothing; one is compressed, one empty."""
    named = "c1\ts1\te1\tc2\ts2\te2\tnote\tcount\n" + "".join(line(i, "", f"\tn{i}\t{i}") for i in range(40))
    commented = "# a\n#b\n" + "".join(line(i) if i % 7 else line(i)[:-1] + "# said\n" for i in range(30)) + "\n   \n# end"
    skipped = "some words\nmore\twords\tof\tit\n" + "".join(line(i, tail=f"\t\t{i * 2}") for i in range(25))
    for name, text in (("a_named.bedpe", named), ("b_commented.bedpe", commented), ("c_skipped.bedpe", skipped), ("empty.bedpe", "")):
        (tmp_path / name).write_text(text)
    with gzip.open(tmp_path / "z.bedpe.gz", "wt") as f:
        f.write(named)
    return tmp_path


def plain(i, prefix="chr"):
    return (f"{prefix}{1 + i % 3}", i * 10, i * 10 + 5, f"{prefix}{1 + i % 2}", i * 20, i * 20 + 7)


def own(files):
    return {"c_skipped.bedpe": {"skiprows": 2, "petcount_col": 7}}


@pytest.mark.parametrize("chunk", [1, 64, 97, 1 << 25])
def test_unlike_files_in_one_read(spark, files, chunk):
    rows = bedpe_files.read_files(spark, [str(files)], own=own(files), chunk=max(chunk, 32)).collect()
    by = {}
    for r in rows:
        by.setdefault(r.file.rpartition("/")[2], []).append(r)
    got = {k: [tuple(r)[:7] for r in sorted(v, key=lambda r: r.place)] for k, v in by.items()}
    named = [(*plain(i), i) for i in range(40)]
    assert got == {"a_named.bedpe": named, "z.bedpe.gz": named, "b_commented.bedpe": [(*plain(i), None) for i in range(30)], "c_skipped.bedpe": [(*plain(i), i * 2) for i in range(25)]}
    text = (files / "b_commented.bedpe").read_bytes()
    assert all(text[r.place :].startswith(f"{r.chromosome_A}\t{r.start_A}\t".encode()) for r in by["b_commented.bedpe"])


def test_ranges_are_partitions(spark, files):
    spark.dataSource.register(bedpe_files.BedpeSource)
    df = spark.read.format("bedpe").option("chunk", 200).load(str(files / "a_named.bedpe"))
    assert df.rdd.getNumPartitions() > 3 and df.count() == 40
    assert bedpe_files.listed(f"file:{files / 'a_named.bedpe'}")[0][1] == (files / "a_named.bedpe").stat().st_size


def test_first_rows_extra_columns_and_filters(spark, files):
    paths = [str(files / "a_named.bedpe"), str(files / "z.bedpe.gz")]
    few = bedpe_files.read_files(spark, paths, (6, "note", "string"), nrows=3, chunk=50)
    assert sorted((r.note, r.petcount) for r in few.collect()) == sorted([(f"n{i}", i) for i in range(3)] * 2)
    rows = bedpe_files.read_files(spark, [str(files)], own=own(files), min_petcount=39, intrachromosomal=False)
    assert {r.petcount for r in rows.collect()} <= {None, 39, *range(40, 50)}
    with pytest.raises(ValueError, match="taken already"):
        bedpe_files.read_files(spark, paths, (2, "x", "long"))
    with pytest.raises(Exception, match="unknown settings"):
        bedpe_files.read_files(spark, paths, own={"a": {"rows": 1}}).collect()


def test_prefix_is_decided_for_each_file(spark, files):
    rows = bedpe_files.read_files(spark, [str(files)], own=own(files))
    assert {r.chromosome_A for r in rows.collect()} == {"chr1", "chr2", "chr3"}


def test_one_reader_takes_lists(spark, files):
    """Several files with unlike heads in the older reader, which passes lists on."""
    paths = [str(files / "a_named.bedpe"), str(files / "b_commented.bedpe")]
    rows = bedpe.read_contacts(spark, paths)
    assert rows.columns == [*bedpe.CORE, "petcount"] and rows.count() == 70
    twice = [str(files / "c_skipped.bedpe"), str(files / "c2.bedpe")]
    (files / "c2.bedpe").write_text((files / "c_skipped.bedpe").read_text().replace("some words", "other\twords\there"))
    assert bedpe.read_contacts(spark, twice, skiprows=2, petcount_col=7).count() == 50


def test_nothing_to_read(spark, files):
    assert bedpe_files.read_files(spark, [str(files / "empty.bedpe")]).count() == 0
    with pytest.raises(Exception, match="nowhere"):
        bedpe_files.read_files(spark, [str(files / "nowhere")]).collect()
    with pytest.raises(ValueError, match="cannot open"):
        bedpe_files.open_store("strange://a/b")
