import gzip
import io
import random
import re
import struct
import threading
from http.server import SimpleHTTPRequestHandler, ThreadingHTTPServer
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from strandlake.operators import coverage, qc
from strandlake.operators import reads as R
from strandlake.plans import commands
from strandlake.plans.tables import shared_folder
from strandlake.sources import bam, fastx, packed, sinks

FASTQ = "@a 1\nACGT\n+\nFFFF\n@b 1\nAC\n+\n@F\n@c 1\n\n+\n\n"


def text_of(folder):
    return "".join(p.read_text() for p in sorted(Path(folder).glob("part-*.txt")))


def test_fastq(spark, tmp_path):
    (tmp_path / "a.fq").write_text(FASTQ)
    (tmp_path / "b.fq.gz").write_bytes(gzip.compress(FASTQ.replace("\n", "\r\n").encode()))
    (tmp_path / "c.fq").write_text(FASTQ.rstrip("\n") + "\n")
    expected = [(0, "@a 1", "ACGT", "FFFF"), (1, "@b 1", "AC", "@F"), (2, "@c 1", "", "")]
    for name in ("a.fq", "b.fq.gz"):
        got = fastx.read_fastx(spark, str(tmp_path / name)).orderBy("ordinal").collect()
        assert [(r.ordinal, r.name, r.seq, r.qual) for r in got] == expected
    assert fastx.read_fastx(spark, str(tmp_path / "*.fq")).select("file").distinct().count() == 2
    with pytest.raises(Exception, match="nothing.fq"):
        fastx.read_fastx(spark, str(tmp_path / "nothing.fq")).collect()


def test_split_files_lose_and_repeat_nothing(spark, tmp_path):
    text = "".join(f"@r{i}\n{'ACGT' * (i % 7 + 1)}\n+\n{'@+F#' * (i % 7 + 1)}\n" for i in range(200))
    (tmp_path / "a.fq").write_text(text)
    for chunk in (37, 100, 1000):
        got = fastx.read_fastx(spark, str(tmp_path / "a.fq"), split="true", chunk=str(chunk)).orderBy("ordinal").collect()
        assert [r.name for r in got] == [f"@r{i}" for i in range(200)]


@pytest.mark.parametrize("read", [1, 7, 64, 1 << 20])
def test_fastq_in_small_reads(tmp_path, monkeypatch, read):
    monkeypatch.setattr(fastx, "READ", read)
    rows = lambda name: [tuple(r.values())[1:] for b in fastx.fastq_batches(fastx.Range(str(tmp_path / name))) for r in b.to_pylist()]
    expected = [(0, "@a 1", None, "ACGT", "FFFF"), (1, "@b 1", None, "AC", "@F"), (2, "@c 1", None, "", "")]
    for name, text in (("a", FASTQ), ("b", FASTQ.replace("\n", "\r\n")), ("c", FASTQ + "\n\n"), ("d", FASTQ[:-1]), ("f", FASTQ + "\r\n\n\n\n\n")):
        (tmp_path / name).write_bytes(text.encode())
        assert rows(name) == expected, name
    (tmp_path / "u").write_bytes("@é\nAC\n+\nFF\n@\xff\nA\n+\nF\n".encode("utf-8"))
    assert [r[1] for r in rows("u")] == ["@é", "@\xff"]
    (tmp_path / "empty").write_bytes(b"")
    assert rows("empty") == []
    for name, text, said in (("x", "@a\nAC\n+\n", "cut off"), ("y", "@a\nAC\n+\nFF\nb\nA\n+\nF\n", "record 1 of .* not FASTQ"), ("z", "@a\nACG\n+\nFF\n", "different lengths"), ("w", "@a\nA\n+\nF\n\n@b\nA\n+\nF\n", "not FASTQ|cut off")):
        (tmp_path / name).write_bytes(text.encode())
        with pytest.raises(ValueError, match=said):
            rows(name)


def test_files_behind_http(spark, tmp_path, bam_file):
    """Read whole and, from a server that gives them, by ranges."""
    (tmp_path / "r.fq.gz").write_bytes(gzip.compress(FASTQ.encode()))

    class Ranges(SimpleHTTPRequestHandler):
        def __init__(self, *args):
            super().__init__(*args, directory=str(tmp_path))

        def log_message(self, *args):
            pass

        def do_GET(self):
            asked = re.match(r"bytes=(\d+)-(\d+)", self.headers.get("Range", ""))
            if not asked or self.path.endswith(".gz"):
                return super().do_GET()
            data = Path(str(tmp_path) + self.path).read_bytes()
            a, b = (int(x) for x in asked.groups())
            part = data[a : b + 1]
            self.send_response(206)
            self.send_header("Content-Range", f"bytes {a}-{a + len(part) - 1}/{len(data)}")
            self.send_header("Content-Length", str(len(part)))
            self.end_headers()
            self.wfile.write(part)

    server = ThreadingHTTPServer(("127.0.0.1", 0), Ranges)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        at = f"http://127.0.0.1:{server.server_port}"
        assert [r.name for r in fastx.read_fastx(spark, f"{at}/r.fq.gz").orderBy("ordinal").collect()] == ["@a 1", "@b 1", "@c 1"]
        bam.index_bam(spark, bam_file).collect()
        assert [r.qname for r in bam.read_bam(spark, f"{at}/a.bam", region="c1:12-20").collect()] == ["y"]
        assert bam.read_bam(spark, f"{at}/a.bam").count() == 4
    finally:
        server.shutdown()


def test_standard_output(spark, capsys):
    sinks.write_lines(spark.createDataFrame([("a",), ("b",)], "value string").orderBy("value"), "-")
    assert capsys.readouterr().out == "a\nb\n"


def test_mixed_records(spark, tmp_path):
    (tmp_path / "m").write_text(">1\nacgtacgtacgtagc\n>2 test\nacgatcgatc\n@3 test2\ncgctagcatagc\ncgatatgactta\n+\n78wo82usd980\n\nd88fau238ud8\n")
    got = fastx.read_fastx(spark, str(tmp_path / "m"), layout="fastx").orderBy("ordinal").collect()
    assert [(r.name, r.comment, r.seq, r.qual) for r in got] == [
        ("1", None, "acgtacgtacgtagc", None), ("2", "test", "acgatcgatc", None), ("3", "test2", "cgctagcatagccgatatgactta", "78wo82usd980d88fau238ud8"),
    ]
    assert commands.fasta_part(spark, str(tmp_path / "m"), "2", 2, 5).first().seq == "gat"


def records():
    m = lambda n: [{"op": 0, "len": n}]
    return [
        {"qname": "x", "flag": 0, "tid": 0, "chrom": "c1", "pos": 0, "mapq": 9, "cigar": m(10), "seq": "ACGTNACGTA", "qual": "FFFFFFFFFF"},
        {"qname": "y", "flag": 16, "tid": 0, "chrom": "c1", "pos": 5, "mapq": 9, "cigar": m(10), "seq": "ACGTNACGTA", "qual": None},
        {"qname": "z", "flag": 0, "tid": 1, "chrom": "c2", "pos": 3, "mapq": 0, "cigar": m(3), "seq": "GGC", "qual": "###"},
        {"qname": "u", "flag": 4, "tid": None, "chrom": None, "pos": -1, "mapq": 0, "cigar": [], "seq": "", "qual": None},
    ]


CONTIGS = [("c1", 40), ("c2", 30)]


@pytest.fixture
def bam_file(tmp_path):
    path = tmp_path / "a.bam"
    path.write_bytes(b"".join(bam.encode_bam(CONTIGS, records())))
    return str(path)


def test_bam(spark, bam_file):
    got = bam.read_bam(spark, bam_file).orderBy("ordinal").collect()
    for row, want in zip(got, records(), strict=True):
        assert (row.qname, row.flag, row.chrom, row.pos, row.seq, row.qual) == tuple(want[k] for k in ("qname", "flag", "chrom", "pos", "seq", "qual"))
        assert [(c.op, c.len) for c in row.cigar] == [(c["op"], c["len"]) for c in want["cigar"]]
    assert [r.qname for r in bam.read_bam(spark, bam_file, region="c1:12-20").collect()] == ["y"]
    assert [tuple(r)[1:] for r in bam.read_contigs(spark, bam_file).collect()] == [(0, "c1", 40), (1, "c2", 30)]


def test_depth_outputs(spark, bam_file, tmp_path):
    commands.bam_depth(spark, bam_file, str(tmp_path / "o"), 10)
    assert text_of(tmp_path / "o.bedGraph") == "c1\t0\t5\t1\nc1\t5\t10\t2\nc1\t10\t15\t1\nc2\t3\t6\t1\n"
    assert text_of(tmp_path / "o.depth").splitlines()[:5] == ["c1\t0\t10\t1.50", "c1\t10\t20\t0.50", "c1\t20\t30\t0.00", "c1\t30\t40\t0.00", "c1\t40\t40\t0.00"]
    assert text_of(tmp_path / "o.sizes") == "c1\t40\nc2\t30\n"
    commands.bam_depth(spark, bam_file, str(tmp_path / "w"), 10, wig=True)
    assert text_of(tmp_path / "w.wig") == "variableStep chrom=c1 span=10\n0 1.50\n10 0.50\nvariableStep chrom=c2 span=10\n0 0.30\n"
    roll = {r.chrom: r.n for r in commands.bam_sliding_count(spark, bam_file, str(tmp_path / "s"), 10).collect()}
    assert roll == {"c1": 2, "c2": 1}
    cells = lambda *rows: "\t".join(f"{i}\t{n}\t{gc:.6f}" for i, (n, gc) in enumerate(rows, 1))
    assert text_of(tmp_path / "s") == (
        "#chr\tchr_len\tchr_sum_read_count\tchr_sum_base\tchr_mean_cov\tchr_mean_GC%" + "".join(f"\t{i}\tcount\tGC%" for i in range(1, 6)) + "\n"
        + f"c1\t40\t2\t20\t0.500000\t40.000000\t{cells((2, 40), (0, 0), (0, 0), (0, 0), (0, 0))}\n"
        + f"c2\t30\t1\t3\t0.100000\t100.000000\t{cells((1, 100), (0, 0), (0, 0), (0, 0))}\n"
    )


def test_split_by_contig(spark, bam_file, tmp_path):
    (tmp_path / "split").mkdir()
    done = {r.chrom: r.n for r in commands.bam_split(spark, bam_file, str(tmp_path / "split")).collect()}
    assert done == {"c1": 2, "c2": 1}
    assert [r.qname for r in bam.read_bam(spark, str(tmp_path / "split" / "c1.bam")).orderBy("ordinal").collect()] == ["x", "y"]
    coverage.split_by_contig(bam.read_bam(spark, bam_file), str(tmp_path / "parts"))
    assert sorted(p.name for p in (tmp_path / "parts").glob("contig=*")) == ["contig=c1", "contig=c2", "contig=unmapped"]


def test_fastq_commands(spark, tmp_path):
    one, two = tmp_path / "1.fq", tmp_path / "2.fq"
    one.write_text("".join(f"@{n} 1\n{s}\n+\nFFFF\n" for n, s in (("1", "TTTT"), ("2", "ACGT"), ("4", "ACGT"))))
    two.write_text("".join(f"@{n} 2\nGGGG\n+\nBBBB\n" for n in "234"))
    out = lambda n: str(tmp_path / n)
    commands.fastq_sort(spark, str(one), out("sorted"))
    assert text_of(out("sorted")).split("\n")[1::4] == ["ACGT", "ACGT", "TTTT"]
    done = commands.fastq_collapse(spark, str(one), out("best"))
    assert (done["reads"], done["distinct"], done["unique_percent"]) == (3, 2, 66.67) and done["seconds"] > 0
    assert text_of(out("best")) == "@2 1\t2\nACGT\n+\nFFFF\n@1 1\t1\nTTTT\n+\nFFFF\n"
    commands.fastq_collapse(spark, str(one), out("all"), keep="all")
    assert text_of(out("all")).startswith("@4 1\t2\nACGT\n+\nFFFF\nFFFF\n")
    commands.fastq_trim(spark, str(one), out("trim"), 1, 3)
    assert text_of(out("trim")).split("\n")[1] == "TT"
    commands.pick_pairs(spark, str(one), str(two), out("p"))
    read = lambda n: [r.name for r in fastx.read_fastx(spark, out(n)).orderBy("file", "ordinal").collect()]
    assert (read("p_1_PE"), read("p_2_PE")) == (["@2 1", "@4 1"], ["@2 2", "@4 2"])
    assert (read("p_1_SE"), read("p_2_SE")) == (["@1 1"], ["@3 2"])
    commands.fastq_sample(spark, str(one), out("s"), n=2, fasta=True)
    assert sum(gzip.decompress(p.read_bytes()).decode().count(">@") for p in Path(out("s_1")).glob("*.gz")) == 2
    summary = commands.fastq_count(spark, f"{one},{two}", out("count"))
    assert {r.reads for r in summary.collect()} == {3, 6}
    commands.two_bit(spark, str(one), out("packed"))
    assert Path(out("packed")).read_bytes()[:2] == bytes([4, 1])
    assert sinks.read_two_bit(Path(out("packed")).read_bytes()) == ["ACGT", "ACGT", "TTTT"]
    commands.two_bit_sequences(spark, out("packed"), out("seqs"))
    assert text_of(out("seqs.decompress")) == "ACGT\nACGT\nTTTT\n"
    commands.quality_codes(spark, str(one), out("codes"))
    assert Path(out("codes")).read_bytes() == b"\x03\x20F\x03" * 3
    assert commands.qc_report(spark, str(one), str(two))["duplicates"].count() == 2


def test_line_tables(spark):
    h = spark.createDataFrame([(3, 2), (4, 5)], "length int, n long")
    assert [r.value for r in sinks.length_histogram_lines(h).collect()] == ["#Len:\t3\t4", "#Freq:\t2\t5"]
    m = spark.createDataFrame([(0, 50, 3)], "cycle int, quality int, n long")
    lines = [r.value for r in sinks.quality_table_lines(qc.quality_table(m, 2)).collect()]
    assert len(lines) == 128 and lines[50] == "3\t0"
    w = spark.createDataFrame([("c", 0, 2), ("c", 1, 4), ("c", 2, 1), ("d", 0, 0)], "chrom string, window long, n long")
    assert sorted(tuple(r) for r in coverage.hits_plot_data(w).collect()) == [("c", 0, 2, 4, 20), ("c", 1, 4, 4, 40), ("c", 2, 1, 4, 10), ("d", 0, 0, 0, 0)]
    q = spark.createDataFrame([("f", 3, 12, 4.0, 2, 6, 200 / 3, 0.0005)], "file string, reads long, bases long, mean_length double, min_length long, max_length long, q20 double, q30 double")
    assert sinks.qc_lines(q).first().value == "f\t3\t12\t4\t2\t6\t66.667\t0.001"
    assert R.parse_fraction(3.25, None) == (0.25, 3)


def test_packed_parts_and_ranges(spark, tmp_path):
    rng = random.Random(3)
    rows = [(i, "".join(rng.choice("ACGT") for _ in range(11)), "".join(rng.choice("#/7<BF") for _ in range(11))) for i in range(101)]
    reads = spark.createDataFrame(rows, "ordinal long, seq string, qual string").repartition(3)
    parts = sinks.two_bit_parts(reads, str(tmp_path / "p")).collect()
    assert sum(r.n for r in parts) == 101
    got = packed.read_two_bit(spark, str(tmp_path / "p"), chunk="7").orderBy("file", "ordinal").collect()
    assert [r.seq for r in got] == [s for _, s, _ in reversed(rows)]
    assert packed.read_two_bit(spark, str(tmp_path / "p"), chunk="7").rdd.getNumPartitions() > 14
    sinks.quality_code_parts(reads, str(tmp_path / "q")).collect()
    got = packed.read_quality_codes(spark, str(tmp_path / "q"), 11).orderBy("file", "ordinal").collect()
    assert [r.qual for r in got] == [q for _, _, q in rows]
    with pytest.raises(ValueError, match="one length"):
        sinks.two_bit_parts(spark.createDataFrame([(0, "A"), (1, "AC")], "ordinal long, seq string"), str(tmp_path / "x"))


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_fasta_ranges(spark, tmp_path, end):
    seqs = {"one": "ACGTACGTAACCGGTTA", "two": "", "three": "GATTACA" * 9}
    path = tmp_path / "g.fa"
    path.write_bytes("".join(f">{n} of test{end}" + "".join(s[i : i + 5] + end for i in range(0, len(s), 5)) for n, s in seqs.items()).encode())
    asked = [(n, a, b) for n in (*seqs, "none") for a in (0, 3, 5, 16, 70) for b in (4, 5, 17, 100) if a < b]
    for _ in range(2):  # without and with the written index
        got = packed.fasta_ranges(spark, str(path), spark.createDataFrame(asked, "name string, begin int, end int")).collect()
        assert {(r.name, r.begin, r.end): r.seq for r in got} == {(n, a, b): seqs[n][a:b] if n in seqs else None for n, a, b in asked}
    assert (tmp_path / "g.fa.fai").read_text().splitlines()[0].split("\t")[:2] == ["one", "17"]
    assert commands.fasta_part(spark, str(path), "three", 2, 9).first().seq == "TTACAGA"
    (tmp_path / "bad.fa").write_text(">x\nAC\nACG\n")
    with pytest.raises(ValueError, match="equally long"):
        packed.index_fasta(str(tmp_path / "bad.fa"))


def test_indexed_bam(spark, tmp_path):
    rng = random.Random(8)
    contigs = [("c1", 200_000), ("c2", 90_000), ("c3", 50)]
    rows = []
    for tid, (name, length) in enumerate(contigs[:2]):
        for i, pos in enumerate(sorted(rng.randrange(length - 5000) for _ in range(1500))):
            cigar = [{"op": 4, "len": 2}, {"op": 0, "len": 20}, {"op": 3, "len": rng.choice([5, 4000])}, {"op": 0, "len": 9}]
            seq = "".join(rng.choice("ACGTN") for _ in range(31))
            rows.append({"qname": f"{name}-{i}", "flag": 16 * (i % 2), "tid": tid, "chrom": name, "pos": pos, "mapq": i % 60, "cigar": cigar, "seq": seq, "qual": None if i % 7 == 0 else "F" * 31})
    rows += [{"qname": f"u{i}", "flag": 4, "tid": None, "chrom": None, "pos": -1, "mapq": 0, "cigar": [], "seq": "ACG"[:i], "qual": None} for i in range(4)]
    path = tmp_path / "big.bam"
    path.write_bytes(b"".join(bam.encode_bam(contigs, rows)))
    whole = bam.read_bam(spark, str(path)).orderBy("ordinal").collect()
    assert [(r.qname, r.pos, r.seq, r.qual, r.mapq) for r in whole] == [(r["qname"], r["pos"], r["seq"], r["qual"], r["mapq"]) for r in rows]
    assert bam.index_bam(spark, str(path)).first().bytes > 100
    assert [p.file for p in bam.BamReader({"path": str(tmp_path)}).partitions()] == [str(path)]
    parts = bam.BamReader({"path": str(path), "chunk": "1"}).partitions()
    assert len(parts) > 3
    cut = bam.read_bam(spark, str(path), chunk="1").collect()
    strip = lambda rs: sorted(tuple(r)[2:] for r in rs)
    assert list(map(str, strip(cut))) == list(map(str, strip(whole))) and len({r.ordinal for r in cut}) == len(rows)
    assert [r.qname for r in sorted(cut, key=lambda r: r.ordinal)] == [r["qname"] for r in rows]
    for region in ("c1", "c2:1-20", "c1:50,001-60,000", "c2:88,000", "c3", "none", "c1:199,000-200,000"):
        name, a, b = coverage.parse_region(region)
        want = [r["qname"] for r in rows if r["chrom"] == name and r["pos"] + sum(c["len"] for c in r["cigar"] if c["op"] in (0, 3)) > a and (b is None or r["pos"] < b)]
        assert sorted(r.qname for r in bam.read_bam(spark, str(path), region=region, chunk="1").collect()) == sorted(want), region
        reads = bam.indexed_parts(str(path), (name, a, b), 1 << 30)
        assert len(reads) == (1 if want else len(reads)) and all(p.end is not None for p in reads)
    one = bam.PushingReader({"path": str(path)})
    assert list(one.pushFilters([bam.EqualTo(("chrom",), "c2")])) and one.region == "c2"
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    assert bam.read_bam(spark, str(path), chunk="1").where("chrom = 'c2' and pos < 100").count() == sum(r["chrom"] == "c2" and r["pos"] < 100 for r in rows)
    spark.conf.unset("spark.sql.python.filterPushdown.enabled")
    path.write_bytes(path.read_bytes()[:-500])
    with pytest.raises(Exception, match=r"cut off|no block|damaged|incomplete|ended"):
        bam.read_bam(spark, str(path), chunk="1").collect()


def _index_by_record(raw):
    """bam.make_index a record at a time: (bins, linear) of each contig and the records without one."""
    f = bam.Blocks(raw)
    contigs = bam.read_header(f)[1]
    bins, linear, without = [{} for _ in contigs], [{} for _ in contigs], 0
    while len(size := (place := f.tell(), f.read(4))[1]) == 4:
        head = np.frombuffer(data := f.read(*struct.unpack("<i", size)), bam._HEAD, 1)[0]
        if head["tid"] < 0:
            without += 1
            continue
        cigar = np.frombuffer(data, "<u4", int(head["ops"]), bam._HEAD.itemsize + int(head["name"]))
        pos = int(head["pos"])
        end = pos + max(1, sum(int(c >> 4) for c in cigar if c & 15 in (0, 2, 3, 7, 8)))
        b = next((first + (pos >> bits) for bits, first in bam.LEVELS if pos >> bits == (end - 1) >> bits), 0)
        chunks = bins[head["tid"]].setdefault(b, [])
        if chunks and chunks[-1][1] == place:
            chunks[-1][1] = f.tell()
        else:
            chunks.append([place, f.tell()])
        for w in range(pos >> 14, (end - 1 >> 14) + 1):
            linear[head["tid"]].setdefault(w, place)
    return bins, linear, without


def test_index_by_the_batch(tmp_path, monkeypatch):
    rng = random.Random(5)
    rows = []
    for tid in (0, 2):
        for i, pos in enumerate(sorted(rng.randrange(300_000) for _ in range(4000))):
            cigar = [{"op": 0, "len": 20}, {"op": 3, "len": rng.choice([5, 40_000])}, {"op": 0, "len": 11}]
            rows.append({"qname": f"r{i}", "flag": 0, "tid": tid, "chrom": f"c{tid}", "pos": pos, "mapq": 0, "cigar": cigar, "seq": "".join(rng.choice("ACGT") for _ in range(rng.randrange(300))), "qual": None})
    rows += [{"qname": "u", "flag": 4, "tid": None, "chrom": None, "pos": -1, "mapq": 0, "cigar": [], "seq": "", "qual": None}] * 3
    data = b"".join(bam.encode_bam([(f"c{i}", 400_000) for i in range(4)], rows))
    for size in (1, 5000, 70_000, 4 << 20):
        monkeypatch.setattr(bam, "BATCH_BYTES", size)
        made = bam.make_index(io.BytesIO(data))
        bins, linear, without = _index_by_record(io.BytesIO(data))
        got_linear, got_chunks = bam.read_index(made)
        assert got_chunks == [sorted(tuple(c) for chunks in of.values() for c in chunks) for of in bins]
        for got, want in zip(got_linear, linear, strict=True):
            assert len(got) == max(want, default=-1) + 1 and all(got[w] == place for w, place in want.items())
        assert struct.unpack("<Q", made[-8:]) == (without,) == (3,)
    rows[1], rows[0] = rows[0], rows[3000]
    with pytest.raises(ValueError, match="unsorted"):
        bam.make_index(io.BytesIO(b"".join(bam.encode_bam([(f"c{i}", 400_000) for i in range(4)], rows))))


def test_records_by_the_batch(monkeypatch):
    odd = [
        {"qname": "", "flag": 65535, "tid": 2, "pos": 7, "mapq": None, "cigar": None, "seq": None, "qual": None},
        {"qname": "é", "flag": 0, "tid": None, "pos": -1, "mapq": 255, "cigar": [], "seq": "acgtnAX=", "qual": ""},
        {"qname": "n" * 254, "flag": 1, "tid": 0, "pos": (1 << 31) - 1, "mapq": 0, "cigar": [{"op": 8, "len": (1 << 28) - 1}, {"op": 0, "len": 0}], "seq": "A", "qual": "!"},
        {"qname": "p", "flag": 1, "tid": 0, "pos": 0, "mapq": 0, "cigar": [{"op": 0, "len": 3}], "seq": "GGC", "qual": "~#I"},
    ]
    schema = pa.schema([("qname", pa.string()), ("flag", pa.int32()), ("tid", pa.int32()), ("pos", pa.int64()), ("mapq", pa.int32()), ("cigar", pa.list_(pa.struct([("op", pa.int32()), ("len", pa.int32())]))), ("seq", pa.string()), ("qual", pa.string())])
    made = pa.RecordBatch.from_pylist([*odd, *odd], schema=schema)
    for a in range(len(made) + 1):
        for n in range(len(made) - a + 1):
            assert bam.encode_records(made.slice(a, n)) == b"".join(map(bam.encode_record, [*odd, *odd][a : a + n]))
    for size in (0, 12, 20, 1000):  # long reads come in runs
        monkeypatch.setattr(bam, "BATCH_BYTES", size)
        runs = list(bam.encoded(made.slice(1)))
        assert b"".join(runs) == bam.encode_records(made.slice(1)) and (size > 20) == (len(runs) == 1)
    other = [{**odd[3], "seq": "Gé"}, odd[0]]
    assert bam.encode_records(pa.RecordBatch.from_pylist([{**r, "qual": None} for r in other], schema=schema)) == b"".join(bam.encode_record({**r, "qual": None}) for r in other)
    for bad in ({"pos": 1 << 31}, {"flag": -1}, {"mapq": 256}, {"qname": "n" * 255}):
        with pytest.raises(struct.error):
            bam.encode_records(pa.RecordBatch.from_pylist([odd[3], {**odd[3], **bad}], schema=schema))


def test_a_contig_is_written_by_many_tasks(spark, tmp_path):
    """A contig is not one task: its rows are dealt by ranges, and copied together in order."""
    n, kept = 3000, {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")}
    rows = [{**records()[0], "tid": int(i % 10 == 0), "chrom": f"c{1 + (i % 10 == 0)}", "pos": i * 7 % 50_000, "ordinal": i, "qname": f"r{i}"} for i in range(n)]
    given = spark.createDataFrame([{k: v for k, v in r.items() if k != "cigar"} for r in rows]).withColumn("cigar", F.expr("array(named_struct('op', 0, 'len', 10))"))
    contigs = spark.createDataFrame([(0, "c1", 50_100), (1, "c2", 50_100)], "tid int, chrom string, length long")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    try:
        made = sinks.bam_files(given, contigs, str(tmp_path / "out"))
        for _ in range(2):  # also when it is computed again
            assert {r.chrom: r.n for r in made.collect()} == {"c1": 2700, "c2": 300}
        assert "rangepartitioning(chrom" in made._jdf.queryExecution().executedPlan().toString()
        seen = list(Path(shared_folder(spark)).glob("bam-ranges-*/*"))
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    assert len(seen) >= 8
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == ["c1.bam", "c2.bam"]
    for chrom in ("c1", "c2"):
        got = bam.read_bam(spark, str(tmp_path / "out" / f"{chrom}.bam")).orderBy("ordinal").collect()
        want = sorted((r for r in rows if r["chrom"] == chrom), key=lambda r: (r["pos"], r["ordinal"]))
        assert [(r.qname, r.pos, r.seq, r.qual) for r in got] == [(r["qname"], r["pos"], r["seq"], r["qual"]) for r in want]


def test_files_are_indexed_by_a_task_each(spark, tmp_path):
    for i in range(6):
        (tmp_path / f"{i}.bam").write_bytes(b"".join(bam.encode_bam(CONTIGS, records())))
    made = bam.index_bam(spark, str(tmp_path)).select("file", F.spark_partition_id().alias("task")).collect()
    assert sorted(Path(r.file).name for r in made) == [f"{i}.bam" for i in range(6)]
    assert len({r.task for r in made}) == 6
