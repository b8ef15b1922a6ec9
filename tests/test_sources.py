"""File readers on small files, and the four-sample cohort from files."""

import gzip

import pytest

from cohortspark.config import AssocConfig
from cohortspark.operators.filters import flip_calls
from cohortspark.plans import association
from cohortspark.plans import statistics as st
from cohortspark.sources import files

HEAD = "Chr\tStart\tEnd\tRef\tAlt\tType\tGenes\tTranscripts\tRegion\tFunction\tAnnotation(c.change:p.change)"
META = "chr1\t{p}\t{p}\tA\tC\tSNV\tg\t{t}\texonic\tnonsynonymous\t."


@pytest.fixture
def study(tmp_path):
    def write(name, text):
        (tmp_path / name).write_text(text)
        return str(tmp_path / name)

    body = [META.format(p=k, t=t) + "\t" + gt for t, gts in (("t1", "0101 1111 0222 2001"), ("t2", "0101 1101 0222 2001")) for k, gt in enumerate(gts.split())]
    matrix = write("m.matrix", "\n".join([HEAD + "\tcase1\tcase2\tcontrol1\tcontrol2", *body]) + "\n")
    ped = write("s.ped", "#FID IID Father Mother Sex Phenotype\n" + "\n".join(f"{i} {i} 0 0 1 {2 if i.startswith('case') else 1}" for i in ("case1", "case2", "control1", "control2")))
    weights = write("w.tsv", "\n".join("\t".join(["chr1", str(k), str(k), "A", "C", "SNV", "g", t, str(w)]) for t in ("t1", "t2") for k, w in enumerate((0.5, 1.5, 3.0, 0.5))))
    return matrix, ped, weights, write


def test_cohort(spark, study):
    matrix, ped, weights, _ = study
    cohort = flip_calls(files.from_files(spark, [matrix], ped, weights))
    assert cohort.sizes == (4, 2)
    assert [round(r.calpha, 6) for r in st.calpha(cohort).orderBy("transcript").collect()] == [-2.0, -1.5]
    masked = study[3]("mask.bed", "chr1\t0\t0\tA\tC\nchr1\t1\t1\tA\tC\n")
    assert files.from_files(spark, [matrix], ped, mask=masked).variants.count() == 4


def test_merge_and_order(spark, study):
    matrix, _, _, write = study
    other = write("n.matrix", HEAD + "\tcontrol2\tcase1\tcontrol1\tcase2\n" + META.format(p=9, t="t1") + "\t0123\n")
    calls = files.merge_matrices([files.read_matrix(spark, matrix), files.read_matrix(spark, other)])
    got = {(r.sample_id, r.dosage, r.missing) for r in calls.where("start = '9'").collect()}
    assert got == {("case1", 1, False), ("control1", 2, False), ("case2", 0, True)}
    with pytest.raises(ValueError, match="more than one file"):
        files.merge_matrices([files.read_matrix(spark, matrix)] * 2)
    assert files.check_sorted(spark, matrix) == []
    assert files.read_matrix(spark, matrix, ["h"]).count() == 0


@pytest.mark.parametrize("line", ["chr1\t1\t1\tA\tC\tSNV\tg", META.format(p=1, t="t").replace("SNV", "XYZ") + "\t0000", META.format(p=1, t="t") + "\t000", META.format(p=1, t="t") + "\t0.00"])
def test_bad_matrix(spark, study, line):
    bad = study[3]("bad.matrix", HEAD + "\ta\tb\tc\td\n" + line + "\n")
    with pytest.raises(Exception, match="bad matrix line"):
        files.read_matrix(spark, bad).collect()


def test_covariates(spark, study):
    path = study[3]("c.cov", "s1 10 blue 1\ns2 12 green 2\ns3 14 red 3\ns4 16 yellow 4\n")
    got = [list(r.x) for r in files.read_covariates(spark, path).orderBy("sample_id").collect()]
    assert got == [[1, 10, 1, 0, 0, 1], [1, 12, 0, 1, 0, 2], [1, 14, 0, 0, 1, 3], [1, 16, 0, 0, 0, 4]]
    with pytest.raises(Exception, match="bad covariate line"):
        files.read_covariates(spark, study[3]("na.cov", "s1 NA\ns2 1\n")).collect()


def test_other_kinds(spark, study):
    write = study[3]
    white = files.read_whitelist(spark, write("w.csv", "Variant,SKAT,WSS\nTYPE:SNV,1,1\nFUNCTION:synonymous,0,1\n"))
    assert sorted(map(tuple, white.collect())) == [("SKAT", "SNV"), ("WSS", "SNV"), ("WSS", "synonymous")]
    perms = files.read_permutations(spark, write("p.txt", "0101\n1010\n1100\n"), 2, 3)
    assert sorted(map(tuple, perms.collect())) == [(2, "1010"), (3, "1100")]
    ref = files.read_refflat(spark, write("r.txt", "G\tT\tchr1\t+\t1\t90\t2\t80\t2\t1,50,\t20,90,\n")).first()
    assert [tuple(e) for e in ref.exons] == [(1, 20), (50, 90)]
    vcf = files.read_vcf(spark, write("v.vcf", "##x\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ta\tb\tc\tchr\nchr1\t5\t.\tA\tC\t.\t.\t.\tGT\t0/1\t1|2:9\t./.\t0/0\n"))
    assert sorted((r.sample_id, r.code) for r in vcf.collect()) == [("a", 1), ("b", 2), ("c", 5)]
    gff = files.read_gff3(spark, write("g.gff3", "#h\n1\tx\tgene\t5\t9\t.\t+\t.\tID=gene:E1.3;Name=AB\n1\tx\tmRNA\t5\t9\t.\t+\t.\tID=transcript:T1.1;Parent=gene:E1.3\n"))
    assert sorted((r.id, r.parent) for r in gff.collect()) == [("E1", None), ("T1", "E1")]
    simple = files.read_simple(spark, write("s.simple", "# a\nRank\tGene\tP\n1\tG\t0.5\n"))
    assert [r.asDict() for r in simple.collect()] == [{"Rank": "1", "Gene": "G", "P": "0.5"}]


def test_codec(spark, study, tmp_path):
    hidden = tmp_path / "hidden.matrix"
    hidden.write_bytes(gzip.compress(open(study[0], "rb").read()))
    assert files.read_matrix(spark, files.with_codec(spark, str(hidden))).count() == 8
    assert files.with_codec(spark, study[0]) == study[0]


def test_scan_from_files(spark, study):
    """Covariates, projection onto the pedigree, whitelist and permutations from files, down to a scan."""
    matrix, ped, weights, write = study
    fewer = write("few.ped", "\n".join(open(ped).read().splitlines()[:-1]))
    assert {r.sample_id for r in files.from_files(spark, [matrix], fewer).calls.collect()} == {"case1", "case2", "control1"}
    with pytest.raises(ValueError, match="without genotypes"):
        files.from_files(spark, [matrix], write("more.ped", open(ped).read() + "\nx x 0 0 1 2\n"))
    covariates = write("c.cov", "case1 1\ncase2 2\ncontrol1 4\ncontrol2 3\n")
    cohort = files.from_files(spark, [matrix], ped, weights, covariates=covariates, genes=["g"])
    assert cohort.samples.columns == ["sample_id", "y", "trait", "x"]
    allowed = files.read_whitelist(spark, write("w.csv", "Variant,WSS\nTYPE:SNV,1\nFUNCTION:nonsynonymous,1\n"))
    labels = files.read_permutations(spark, write("p.txt", "0101\n1010\n1100\n"))
    rows = association.scan(cohort, AssocConfig(method="WSS", nperm=3, successes=9), allowed, external=labels).collect()
    assert {r.transcript for r in rows} == {"t1", "t2"} and all(r.permutations == 3 for r in rows)
    # The third line is the observed labels: a tie, which counts.
    assert all(r.successes >= 1 for r in rows)


def test_sparse_genotypes(spark, study):
    """A field that lists calls gives the same calls as one with a digit for each sample, in one file or in two."""
    matrix, ped, weights, write = study
    dense = files.from_files(spark, [matrix], ped, weights)
    text = open(matrix).read().splitlines()

    def sparse(line):
        *rest, gt = line.split("\t")
        return "\t".join([*rest, "*" + ",".join(f"{k}:{d}" for k, d in enumerate(gt) if d != "0")])

    mixed = write("mixed.matrix", "\n".join([text[0], *(sparse(x) if k % 2 else x for k, x in enumerate(text[1:]))]))
    other = files.from_files(spark, [mixed], ped, weights)
    assert sorted(other.calls.collect()) == sorted(dense.calls.collect()) and other.calls.count() > 8
    assert sorted(files.matrix_calls(files.read_matrix(spark, mixed)).collect()) == sorted(files.matrix_calls(files.read_matrix(spark, matrix)).collect())
    half = [write("one.matrix", "\n".join([text[0], *map(sparse, text[1:5])])), write("two.matrix", "\n".join([HEAD + "\tcontrol2\tcase1\tcontrol1\tcase2", META.format(p=9, t="t1") + "\t*1:2,3:5"]))]
    calls = files.from_files(spark, half, ped).calls.where("variant_id like '%,9,9,%'").collect()
    assert {(r.sample_id, r.dosage, r.missing) for r in calls} == {("case1", 2, False), ("case2", 0, True)}
    fewer = write("fewer.matrix", HEAD + "\tcase1\tcase2\tcontrol1\n" + META.format(p=9, t="t1") + "\t001\n")
    with pytest.raises(ValueError, match="different samples"):
        files.from_files(spark, [matrix, fewer], ped)


@pytest.mark.parametrize("gt", ["*4:1", "*1:1,1:2", "*2:1,0:1", "*1:", "*1:1,", "*1:12", "*x:1", "*-1:1", "1:1"])
def test_bad_sparse_genotypes(spark, study, gt):
    bad = study[3]("bad.matrix", HEAD + "\ta\tb\tc\td\n" + META.format(p=1, t="t") + f"\t{gt}\n")
    with pytest.raises(Exception, match="bad matrix line"):
        files.read_matrix(spark, bad).collect()


def test_study_files_do_not_grow_with_zeros(spark, tmp_path, monkeypatch):
    """A study's matrix file has calls, not a digit for each sample and variant."""
    from cohortspark.plans import queries

    monkeypatch.setattr(queries, "shared_path", lambda _, kind: str(tmp_path / kind))
    assert queries.cohort_by_files(spark, "/root/testdata/sf0.01").calls.count() > 50_000
    size = sum(f.stat().st_size for f in (tmp_path / "files" / "matrix").glob("part-*"))
    assert 0 < size < 2_971 * 1_500 / 2
