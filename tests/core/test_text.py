"""Extraction, segmentation, files and grounding on inline fixtures of our own."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from plinth.functions import extract
from plinth.functions import text as fx
from plinth.operators import grounding, metrics, retrieval, segment, vector
from plinth.sources import files


@pytest.mark.parametrize(("text", "canonical"), [
    ("2020 INSC 12", "case:sc:insc:2020:12"), ("2021:DHC:77", "case:del:neutral:2021:77"), ("(2010) 4 SCC 9", "case:sc:scc:2010:4:9"), ("(2010) 4 SCC (L&S) 9", "case:sc:scc_ls:2010:4:9"),
    ("[2001] 2 SCR 8", "case:sc:scr:2001:2:8"), ("2015 SCC OnLine Bom 3", "case:bom:scc_online:2015:3"), ("AIR 1990 Ker 5", "case:ker:air:1990:5"), ("MANU/TN/0123/2011", "case:mad:manu:0123:2011"),
    ("ILR (2003) Delhi 44", "case:del:ilr:2003:44"), ("2009 Cri LJ 6", "case:unknown:crilj:2009:6"),
])
def test_each_reporter(spark, text, canonical):
    assert [c["canonical_id"] for c in extract.citations(f"see {text}, and")] == [canonical]
    row = spark.range(1).select(fx.citations(F.lit(f"see {text}, and")).alias("c")).first()
    assert [c.canonical_id for c in row.c] == [canonical]


def test_year_bounds_and_unknown_court():
    assert extract.citations("AIR 1700 SC 1 and 2999 INSC 4 and 2020:ZZZ:4") == []


def test_title_joins_the_citation_after_it():
    text = "See Ram Singh v. State of Bihar, AIR 1999 SC 12. Also Vishaka v. Rao stands alone without any reporter citation near it; (2001) 1 SCC 5 too."
    found = extract.citations(text)
    assert [(c["kind"], c["canonical_id"]) for c in found] == [("combined", "case:sc:air:1999:12"), ("case_title", "case:title:vishaka_v_rao"), ("reporter", "case:sc:scc:2001:1:5")]
    assert text[found[0]["start"] : found[0]["end"]] == "Ram Singh v. State of Bihar, AIR 1999 SC 12"


def test_sweep_keeps_the_longer_span():
    span = lambda s, e, k: {"start": s, "end": e, "kind": k}
    assert extract.sweep([span(0, 5, "reporter"), span(3, 12, "neutral"), span(12, 14, "neutral")], extract._RANK) == [span(3, 12, "neutral"), span(12, 14, "neutral")]
    assert extract.sweep([span(0, 5, "case_title"), span(0, 5, "combined")], extract._RANK) == [span(0, 5, "combined")]


def test_entities():
    found = extract.entities("The Delhi High Court, per Justice Asha Rao, on 12-03-2019 in Ram Lal v. Union of India")
    assert [(e["kind"], e["extra"]) for e in found] == [("Court", "HC"), ("Judge", None), ("Date", None), ("Party", "petitioner"), ("Party", "respondent")]


STATUTE = "THE INDIAN PENAL CODE, 1860\nCHAPTER I INTRODUCTION\n1. Title.\nThis act.\n(1) First.\nProvided that none.\nCHAPTER II GENERAL\n2A. Meaning.\nExplanation. words\nIllustration. more\n"


def test_statute_units_stand_in_their_own_chapter():
    found = segment.statute(STATUTE)
    kinds = [s[0] for s in found]
    assert kinds == ["Act", "Chapter", "Section", "Subsection", "Proviso", "Chapter", "Section", "Explanation", "Illustration"]
    sections = [s for s in found if s[0] == "Section"]
    assert [(s[1], s[5], s[6]) for s in sections] == [("Section 1", "Chapter I", "ipc:1"), ("Section 2A", "Chapter II", "ipc:2a")]
    for s in found[1:]:
        assert STATUTE[s[3] : s[4]].strip().startswith(s[2][:10]) or s[0] == "Chapter"


def test_judgment_roles():
    found = segment.judgment("Preamble\n1. FACTS OF THE CASE are short.\n2. WE HOLD so.\n3. The appeal is dismissed.\n")
    assert [(s[1], s[6]) for s in found] == [("Paragraph 1", "facts"), ("Paragraph 2", "holding"), ("Paragraph 3", "order")]
    assert segment.judgment("No numbers here") == [("Paragraph", "Paragraph 1", "No numbers here", 0, 15, None, None)]
    assert segment.judgment("  ") == []


def test_private_kinds():
    assert segment.fir("FIR No. 45/2020 under sections 302, 34 of IPC\nstory")[0][6] == "no=45/2020;sections=302, 34"
    assert [s[0] for s in segment.chargesheet("Charge-sheet No. 4\nAccused No. 1: Ram Lal\nPW-2 saw it")] == ["Document", "Party", "Witness"]
    clauses = segment.contract('"Goods" means things\n\n1. Supply of goods.\n2. Payment terms.\n\nSCHEDULE A\nlist')
    assert [s[1] for s in clauses] == ["Definition: Goods", "Clause 1", "Clause 2", "SCHEDULE A"]
    assert [s[0] for s in segment.generic("Exhibit P-1 here\n\nStatement of Ram Lal follows\n\nplain", "notice")] == ["Exhibit", "Statement", "Notice"]
    for kind in ("statute", "judgment", "fir", "chargesheet", "contract", "notice"):
        assert segment.segments(None, kind) == [] == segment.segments("", kind)


def test_html_docx_and_decoding(spark, tmp_path):
    page = "<html><head><title>t</title></head><body><nav>menu</nav><div class='sidebar x'>side</div><main><p>Main <b>text</b></p><script>no()</script></main><p>out</p></body></html>"
    assert files.html_text(page).split() == ["Main", "text"]
    assert files.html_text("<p>only body") == "only body"
    box = io.BytesIO()
    ns = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    with zipfile.ZipFile(box, "w") as z:
        z.writestr("word/document.xml", f"<w:document {ns}><w:body><w:p><w:r><w:t>Hello</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>")
    assert files.docx_text(box.getvalue()) == "Hello\na | b"
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "fir_1.txt").write_bytes("café!".encode("latin-1"))
    (tmp_path / "a.html").write_text(page)
    (tmp_path / "skip.part").write_text("x")
    got = {r["name"]: (r.kind, " ".join(r.text.split())) for r in files.corpus(spark, str(tmp_path)).collect()}
    assert got == {"fir_1.txt": ("fir", "café!"), "a.html": ("statute", "Main text")}


def test_sources(spark, tmp_path):
    for n in ("ildc_2001_x.txt", "seeded.txt"):
        (tmp_path / n).write_text("t")
    seeds = spark.createDataFrame([("seeded", "Seeded", "u", "SC", 1999)], "external_id string, title string, url string, court string, year int")
    refs = files.with_seeds(seeds, files.scan(spark, str(tmp_path)))
    assert sorted((r.external_id, r.year) for r in refs.collect()) == [("ildc_2001_x", 2001), ("seeded", 1999)]
    assert [r.external_id for r in files.with_seeds(seeds, files.scan(spark, str(tmp_path)), courts=["sc"]).collect()] == ["seeded"]
    reg = files.Registry()
    reg.add("a", lambda s: seeds)
    reg.add("b", lambda s: seeds, enabled=False)
    assert reg.names() == ["a"] and reg.get("a")(spark) is seeds
    for name in ("b", "c"):
        with pytest.raises(KeyError):
            reg.get(name)
    clock = [0.0]
    bucket = files.TokenBucket(1.0, 2, lambda: clock[0])
    assert [bucket.acquire("h") for _ in range(3)] == [0.0, 0.0, 1.0] and bucket.acquire("other") == 0.0
    store = files.LocalStore(str(tmp_path / "store"))
    store.put("a/b", b"x")
    assert store.get("a/b") == b"x" and store.exists("a/b") and not store.exists("a/c")
    with pytest.raises(ValueError):
        store.put("../x", b"")


def test_enforcement(spark):
    text = "Answer: Good [S1]. Bare claim. Ghost [S9]. Mixed [S1] [S9].\nLegal basis:\n- one [S1]\n- none\nConfidence: HIGH\nInsufficient evidence: NO"
    rows = spark.createDataFrame([(1, text, ["S1"]), (2, "Answer: nothing", ["S1"]), (3, grounding.REFUSAL, [])], "qid int, text string, allowed array<string>")
    got = {r.qid: r for r in grounding.enforce(rows).collect()}
    assert got[1].answer == "Good [S1]. Mixed [S1] ." and got[1].legal == ["one [S1]"] and got[1].fabricated == ["S9"]
    assert (got[1].confidence, got[1].insufficient, got[1].total, got[1].n_kept, got[1].rejection_rate) == ("high", False, 4, 2, 0.5)
    assert (got[2].answer, got[2].confidence, got[2].insufficient) == ("", "low", True) and got[3].insufficient


def test_pack_limits(spark):
    rows = [(1, f"n{k:02d}", 1 + k % 2, k + 1, "word " * (200 if k else 5000)) for k in range(40)]
    ranked = spark.createDataFrame(rows, "qid int, node string, tier int, rank int, excerpt string")
    pack = retrieval.evidence_pack(ranked).orderBy("pos").collect()
    assert len(pack) <= 12 and max(sum(1 for r in pack if r.tier == t) for t in (1, 2)) <= 6
    assert sum(r.tokens for r in pack) <= 3500 and [r.marker for r in pack] == [f"S{k + 1}" for k in range(len(pack))]
    one = retrieval.evidence_pack(ranked, max_tokens=10).collect()
    assert [r.node for r in one] == ["n00"]


def test_metrics_of_nothing_found(spark):
    schema = "dataset string, item_id int, answer string, pack_spans array<string>, pack_tiers array<int>, pack_nodes array<string>, cite_labels array<string>, cite_ok array<boolean>, refused boolean, latency double, expected_sections array<string>, expected_nodes array<string>, expected_target string, expected_tier1 boolean"
    rows = spark.createDataFrame([("d", 1, "", [], [], [], [], [], True, 1.0, None, None, None, None)], schema)
    s = metrics.summarise(rows).first()
    assert (s.grounding_rate, s.unsupported_claim_rate, s.refusal_rate, s.true_refusal_rate, s.false_refusal_rate, s.latency_p95_s) == (0.0, 1.0, 1.0, 1.0, 0.0, 1.0)


def test_hash_embedding_is_unit_length(spark):
    rows = spark.createDataFrame([(1, "alpha beta beta"), (2, ""), (3, None)], "id int, text string")
    e = vector.embed_sparse(rows, "id", "text").collect()
    assert {r.id for r in e} == {1} and abs(sum(r.weight**2 for r in e) - 1) < 1e-9


def test_hash_embedding_counts_texts_where_they_are_read(spark, monkeypatch):
    """No word is shuffled; rows that share a key, null too, embed like one text; a small memory of tokens changes nothing."""
    monkeypatch.setattr(vector, "KNOWN_TOKENS", 2)
    monkeypatch.setattr(vector, "COUNTED_ROWS", 2)
    texts = {1: "alpha beta beta", 2: "\u0130zmir 20 \u212am", None: "x y", 4: "one, two; three four one", 5: "", 6: None}
    rows = spark.createDataFrame(list(texts.items()), "id int, text string")
    made = vector.embed_sparse(rows, "id", "text")
    assert "Exchange" not in made._jdf.queryExecution().executedPlan().toString()
    got = {(r.id, r.bucket): r.weight for r in made.collect()}
    assert got == {(k, b): w for k, t in texts.items() for b, w in enumerate(vector.hash_vector(t or "")) if w}
    more = rows.unionByName(spark.createDataFrame([(1, "Beta gamma"), (None, "y z"), (6, "six")], rows.schema))
    texts |= {1: "alpha beta beta Beta gamma", None: "x y y z", 6: "six"}
    got = {(r.id, r.bucket): r.weight for r in vector.embed_sparse(more, "id", "text").collect()}
    assert got == {(k, b): w for k, t in texts.items() for b, w in enumerate(vector.hash_vector(t or "")) if w}


def test_fetched_text_keeps_sixty_thousand_characters(spark):
    from plinth.sources import files

    rows = [(1, "a" * 6_001, ""), (2, " " + "b" * 60_000 + "\n", ""), (3, "c" * 60_001, "")]
    got = {r.i: r.t for r in spark.createDataFrame(rows, "i int, text string, source string").select("i", files.fetched_text(["text", "source"]).alias("t")).collect()}
    assert got == {1: "a" * 6_001, 2: "b" * 60_000, 3: "c" * 60_000 + "\n\n[... truncated by fetch_hf_corpora ...]"}
