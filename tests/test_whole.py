"""Queries read every row and whole sequences: against plain Python on small tables."""

import re
from collections import Counter

import pandas as pd
import pytest

from siteline.plans import catalogue

DIR = "/root/testdata/sf0.001"


def rows(spark, name, sf_dir=DIR):
    return Counter(tuple(r) for r in catalogue.queries()[name](spark, sf_dir).collect())


@pytest.fixture(scope="module")
def seqs():
    d = pd.read_parquet(f"{DIR}/documents.parquet")
    return {i: re.sub("[^ACGTN]", "", t.upper()) for i, t in zip(d.doc_id, d.text, strict=True) if t is not None}


def test_fasta_has_all_contigs(spark, seqs):
    want = Counter((str(i), s[10:100]) for i, s in seqs.items() if len(s) >= 20)
    assert max(int(i) for i, _ in want) > 40 and rows(spark, "src_fasta_random") == want


def test_fasta_subset_takes_contigs_from_the_whole_file(spark, seqs):
    from siteline.plans import q_files

    at = max(i for i, s in seqs.items() if len(s) >= 20)
    g = q_files.genome(spark, DIR, [str(at)])
    assert at > 40 and "".join(r["seq"] for r in sorted(g.collect(), key=lambda r: r["chunk_id"])) == seqs[at]


def test_bigwig_values_of_all_peaks(spark):
    from siteline.plans.proxies import view

    signal = Counter()
    for r in view(spark, DIR, "aln").filter("mapq >= 255 and strand = '+'").collect():
        signal[r["chrom"], r["start_pos"]] += 1
    peaks = view(spark, DIR, "peaks").collect()
    want = Counter((p["peak_idx"], x, float(signal[p["chrom"], x])) for p in peaks for x in range(p["start_pos"], p["end_pos"]))
    assert len(peaks) > 200 and rows(spark, "src_bigwig_values") == want


def revcomp(s):
    return s[::-1].translate(str.maketrans("ACGTN", "TGCAN"))


def kmers(s, k=20):
    return [s[j : j + k] for j in range(len(s) - k + 1)]


def test_revcomp_of_whole_sequences(spark, seqs):
    assert rows(spark, "fn_revcomp") == Counter((i, revcomp(s)) for i, s in seqs.items()) and max(map(len, seqs.values())) > 200


def test_kmers_of_whole_sequences_and_both_strands(spark, seqs):
    want = Counter(x for s in seqs.values() for own in (s, revcomp(s)) for x in kmers(own))
    assert rows(spark, "fn_kmers") == Counter(want.items())


def test_onehot_of_whole_sequences(spark, seqs):
    want = Counter((b, j) for s in seqs.values() for j, b in enumerate(s) if b != "N")
    assert rows(spark, "ml_onehot") == Counter((*x, n) for x, n in want.items())


def classes(reads, references):
    """read -> class of its first k-mer in a reference of (seq, class, priority)."""
    known = {}
    for s, name, priority in references:
        for x in {*kmers(s), *kmers(revcomp(s))}:
            known[x] = min(known.get(x, (9, "")), (priority, name))
    return {i: next((known[x][1] for x in kmers(s) if x in known), None) for i, s in reads.items()}


def test_reads_are_classified_by_whole_sequences(spark, seqs):
    long = {i: s for i, s in seqs.items() if len(s) >= 20}
    want = classes(long, [(s, "5s" if i % 2 else "35s", i % 2) for i, s in long.items()])
    assert rows(spark, "join_sequence_lookup") == Counter(want.items())


def test_rrna_content_of_whole_inserts(spark, seqs):
    """Per run and language: inserts up to either adapter, against the references of their language, of which es has no rRNA and fr none."""
    import pandas as pd

    docs = pd.read_parquet(f"{DIR}/documents.parquet").set_index("doc_id")
    lang, run = docs.lang.to_dict(), docs.source.to_dict()
    kinds = ("rrna_35s", "rrna_5s", "organellar")
    want = {}
    for name in set(lang.values()):
        own = {i: s for i, s in seqs.items() if lang[i] == name}
        refs = [(s, kinds[i % 3], i % 3) for i, s in own.items() if len(s) >= 20 and name != "fr" and (name != "es" or i % 3 == 2)]
        inserts = {i: s[: min((p for p in (s.find("TTAGA"), s.find("GAATC")) if p >= 0), default=len(s))] for i, s in own.items()}
        found = classes({i: s for i, s in inserts.items() if len(s) >= 20}, refs) if refs else {}
        for source in {run[i] for i in own}:
            mine = [c for i, c in found.items() if run[i] == source]
            pct = lambda *x: round(100 * sum(c in x for c in mine) / len(mine), 2)
            row = (("yes" if name != "es" else "no"), pct(kinds[0]), pct(kinds[1]), pct(kinds[2]), pct(*kinds)) if mine else (None,) * 5
            want[f"{source}/{name}"] = (len(mine), *row)
    assert {r.experiment: tuple(r)[1:] for r in catalogue.queries()["qc_rrna_content"](spark, DIR).collect()} == want


def test_hits_beyond_the_start(spark, tmp_path):
    """Reads whose only hit, or whose reference, lies far from the start or has a large id."""
    import random

    from siteline.operators import qc

    r = random.Random(3)
    seq = lambda n: "".join(r.choice("ACGT") for _ in range(n))
    refs = [(seq(300), "5s", 1), (seq(300), "35s", 0)]
    reads = {0: seq(200) + refs[0][0][250:280] + seq(50), 1: seq(150) + revcomp(refs[1][0])[20:60], 2: seq(400), 3: seq(90) + refs[1][0][270:] + refs[0][0][:40]}
    got = qc.classify_reads(spark.createDataFrame(list(reads.items()), "read long, seq string"), spark.createDataFrame(refs, "seq string, class string, priority int"), 20)
    assert {x["read"]: x["class"] for x in got.collect()} == classes(reads, refs) == {0: "5s", 1: "35s", 2: None, 3: "35s"}
