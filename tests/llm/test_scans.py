import pytest

from tektonis.llm import scans


@pytest.mark.parametrize("line,page,yes", [("- 12 -", 12, True), ("_12_", 12, True), ("Seite 12 von 196", 12, True), ("S. l2", 12, True), ("2005.", 12, False), ("Wand 12", 12, False), ("12", None, False), ("[12]", None, True), ("", 1, False)])
def test_page_number(line, page, yes):
    assert scans.page_number(line, page) is yes


@pytest.mark.parametrize("word,after,want", [("2O03", "", "2003"), ("B,8", "cm", "8,8"), ("KB-7l38", "", "KB-7138"), ("1990", "", None), ("Sol", "", None), ("Z", "Monaten", "2")])
def test_numbers(word, after, want):
    assert scans.repaired_number(word, after) == want


def test_distance_knows_confusions():
    assert scans.weighted_distance("Darnpfsperre", "Dampfsperre") < 0.5 < scans.weighted_distance("Dampfspxrre", "Dampfsperre")
    for a, b in (("wurderi", "wurden"), ("zvvischen", "zwischen"), ("5chicht", "Schicht")):
        assert scans.weighted_distance(a, b) < 0.5 and scans.deletes(a) & scans.deletes(b)


def test_repair(spark):
    body = "Die Wand wurde mit Putz versehen und Leichtbeton- oder Ziegelteile folgten der Schicht"
    fine = [(i, f"S{i % 7}", f"Die Wand wurde mit Putz versehen.\nDie Schicht aus Holzwolle-Leichtplatten und Kalk wurde dünn. {body}.") for i in range(60)]
    bad = "Die Wand wnrde mit Holz-\n- 8 -\nReihe Peldri, Band 4\nwolle versehen. Die Schi-\ncht und Leichtbeton-\noder Holzwolle-\nLeichtplatten wurde 2O03 dünn.\n4.1 Die Merkmale"
    schema = "box_id bigint, scan_id string, printed_page int, page_header struct<main_section:struct<section:string,title:string>,subseries:struct<section:string,title:string>>, properties map<string,string>"
    rows = [(i, s, 3, None, {"Wand": t, "Dicke": "8", "leer": "", "null": None, "json": '{"a":\n "wnrde"}'}) for i, s, t in fine]
    rows += [(90, "S1", 8, (("1", "Reihe Peldri, Band 4"), None), {"Wand": bad}), (90, "S1", 8, (("1", "Reihe Peldri, Band 4"), None), {"Wand": bad}), (91, None, None, None, None), (92, "S1", 3, None, {"x": "Wand " * 30000})]
    df = spark.createDataFrame(rows, schema).selectExpr("*", "1 AS key", "2 AS prop", "3 AS n", "4 AS word")
    got = scans.repair(df)
    assert got.columns == ["box_id", "prop", "line_no", "kind", "repaired"]
    out = sorted(map(tuple, got.where("box_id = 90").collect()))
    assert (90, "Wand", 1, "char", "wurde") in out and (90, "Wand", 2, "page_no", "") in out and (90, "Wand", 3, "header", "") in out
    assert (90, "Wand", 1, "hyphen", "Holzwolle") in out and (90, "Wand", 4, "hyphen", "Schicht") in out and (90, "Wand", 6, "hyphen", "Holzwolle-Leichtplatten") in out
    assert (90, "Wand", 7, "char", "2003") in out and not any(r[2] == 5 for r in out) and len(out) == len(set(out))
    assert got.where("box_id <> 90").count() == 0
    assert sorted(map(tuple, scans.repair(df, title_limit=0).where("box_id = 90").collect())) == out
    assert sorted(map(tuple, scans.repair(df, word_limit=0).where("box_id = 90").collect())) == out
    assert scans.repair(df.limit(0)).count() == 0


def test_context_decides_between_candidates(spark):
    schema = "box_id bigint, scan_id string, printed_page int, page_header struct<main_section:struct<section:string,title:string>,subseries:struct<section:string,title:string>>, properties map<string,string>"
    rows = [(i, "S", 1, None, {"t": "Ein hoher Baum steht dort und saurer Barm liegt hier"}) for i in range(40)]
    rows += [(80, "S", 1, None, {"t": "Ein hoher Banm steht dort"}), (81, "S", 1, None, {"t": "und saurer Banm liegt hier"})]
    df = spark.createDataFrame(rows, schema)
    assert sorted(map(tuple, scans.repair(df).collect())) == [(80, "t", 1, "char", "Baum"), (81, "t", 1, "char", "Barm")]


PAGES = "box_id bigint, scan_id string, printed_page int, page_header struct<main_section:struct<section:string,title:string>,subseries:struct<section:string,title:string>>, properties map<string,string>"


@pytest.mark.parametrize("read,meant", [("Karnrner", "Kammer"), ("Sornrner", "Sommer"), ("rnornent", "moment"), ("clarnit", "damit"), ("Stahlbctonrahrnen", "Stahlbetonrahmen"), ("vvinclig", "windig"), ("Ziinmcr", "Zimmer"), ("Fclsen", "Felsen")])
def test_two_confusions_are_within_reach(read, meant):
    assert scans.weighted_distance(read, meant, 1.0) <= 0.9
    assert scans.deletes(read) & scans.deletes(meant)


def test_keys_reach_any_two_confusions():
    import random

    rng = random.Random(2)
    words = ["".join(rng.choice("abcdefghiklmnorstuw") for _ in range(rng.randrange(5, 14))) for _ in range(400)]
    met = total = 0
    for w in words:
        read = w
        for _ in range(2):
            options = [(i, a, b) for a, b in scans.CONFUSIONS for i in range(len(read)) if read.startswith(a, i)]
            i, a, b = rng.choice(options)
            read = read[:i] + b + read[i + len(a) :]
        if read != w and scans.weighted_distance(read, w, 1.0) <= 0.9:
            total += 1
            met += bool(scans.deletes(read) & scans.deletes(w))
    assert total > 300 and met >= 0.97 * total, (met, total)


@pytest.mark.parametrize("line,yes", [("Selte 12", True), ("8lait 12 vori 90", False), ("Scite 12 von 90", True), ("Blatt 12 aus 90", True), ("Beton 12", False), ("12 mm 90", False)])
def test_misread_page_words(line, yes):
    assert scans.page_number(line, 12) is yes


def test_a_brace_makes_no_record(spark):
    assert scans.is_record('{"a": 1}') and scans.is_record(" [1]") and not scans.is_record("{Die Wand") and not scans.is_record("Wand")
    rows = [(i, "S", 1, None, {"t": "Die Schicht aus Holz"}) for i in range(40)] + [(80, "S", 1, None, {"t": "{Die 5chicht aus Holz"}), (81, "S", 1, None, {"t": '{"a": "5chicht"}'})]
    assert sorted(map(tuple, scans.repair(spark.createDataFrame(rows, PAGES)).collect())) == [(80, "t", 1, "char", "Schicht")]


def test_confusions_are_learned(spark):
    import random

    rng = random.Random(8)
    words = sorted({"".join(rng.choice("adeghlmnorst") for _ in range(9)) for _ in range(60)})
    fine = " ".join(words)
    bad = [w[:k] + "x" + w[k + 1 :] for w in words if (k := w.find("g", 1, 6)) > 0]  # g is read as x, which no list knows
    odd = [w[:4] + "z" + w[5:] for w in words[:4]]  # a few letters read as z, whatever they were
    rows = [(i, "S", 1, None, {"t": fine}) for i in range(60)] + [(90, "S", 1, None, {"t": " ".join(bad)}), (91, "S", 1, None, {"t": " ".join(odd)})]
    got = {r.repaired for r in scans.repair(spark.createDataFrame(rows, PAGES)).collect()}
    assert len(bad) > 12 and got == {w for w in words if w.find("g", 1, 6) > 0}


def test_paragraphs(spark):
    body = "Die Wand wurde mit Putz versehen und Leichtbeton- oder Ziegelteile folgten der Schicht"
    rows = [(i, f"S{i % 7}", 3, None, {"Wand": f"Die Wand wurde mit Putz versehen.\nDie Schicht aus Holzwolle und Kalk wurde dünn. {body}."}) for i in range(60)]
    bad = "„Die Wond wurde mit Holz-\n- 8 -\nwolle“, (wnrde) versehen.\n\nLeichtbeton-\noder Ziegelteile 2O03\n12"
    rows += [(90, "S1", 8, None, {"a": bad, "j": '{"x": "wnrde"}', "n": None, "e": " "}), (91, "S1", 8, None, {"a": "- 8 -\n8"}), (92, None, None, None, None)]
    df = spark.createDataFrame(rows, PAGES)
    got = sorted(map(tuple, scans.paragraphs(df).where("box_id >= 90").collect()))
    assert got == [(90, "a", 1, "„Die Wand wurde mit Holzwolle“, (wurde) versehen."), (90, "a", 2, "Leichtbeton- oder Ziegelteile 2003 12"), (90, "j", 1, '{"x": "wnrde"}')]
    assert scans.paragraphs(df).where("box_id < 90").count() == 60 and scans.paragraphs(df.limit(0)).count() == 0
