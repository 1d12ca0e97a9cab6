import random

import pytest
from pyspark.sql import functions as F

from lexweave.functions import anonymise, derived, legal, scalars, sections, swiss


def one(spark, text, f):
    return spark.createDataFrame([(text,)], "t string").select(f(F.col("t")).alias("x")).first()[0]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("Verstoß gegen Art. 6 DSGVO", ["Art. 6 DSGVO"]),
        ("Art. 6 Abs. 1 lit. f DSGVO", ["Art. 6 Abs. 1 lit. f DSGVO"]),
        ("Artikel 17 Absatz 2 der DSGVO", ["Art. 17 Abs. 2 DSGVO"]),
        ("Art. 5 DS-GVO und Art. 5 DSGVO", ["Art. 5 DSGVO"]),
        ("Article 16(1) GDPR", ["Art. 16 Abs. 1 DSGVO"]),
        ("Art. 15-18 DSGVO", ["Art. 15-18 DSGVO"]),
        ("art. 6, 9 dsgvo", ["Art. 6 DSGVO"]),
        ("Art. 4 Verordnung (EU) 2016/679", ["Art. 4 DSGVO"]),
        ("nichts", []),
        ("", []),
        (None, []),
    ],
)
def test_articles(spark, text, want):
    assert one(spark, text, legal.gdpr_articles) == want


def test_bdsg_sections(spark):
    assert one(spark, "§ 26 BDSG, § 26 Abs. 1 BDSG, §§ 31 bis 33 BDSG, §§ 9 bis 7 BDSG", legal.bdsg_sections) == ["§ 26 Abs. 1 BDSG", "§ 26 BDSG", "§ 31 BDSG", "§ 32 BDSG", "§ 33 BDSG"]


def test_keywords_keep_case_and_umlauts(spark):
    assert one(spark, "Die LÖSCHUNG und Auskunft; xEinwilligung", legal.keywords) == ["LÖSCHUNG", "Auskunft"]


def test_relevance(spark):
    assert one(spark, "Nach der DSGVO sind personenbezogene Daten geschützt", legal.relevance) == 17
    assert one(spark, "Mietrecht", legal.relevance) == 0


def test_two_stage(spark):
    docs = spark.createDataFrame(
        [
            ("1", "Urteil zur DSGVO", "<h2>Tenor</h2>Die Verarbeitung personenbezogener Daten nach Art. 6 DSGVO <h2>Gründe</h2> Bußgeld von EUR 1.000. Recht auf Auskunft. Revision.", "VG Berlin"),
            ("2", "Mietvertrag", "Die Miete ist zu zahlen.", "AG Bonn"),
        ],
        "id string, title string, content string, court string",
    ).selectExpr("*", "'1 K 1/20' AS case_number", "TIMESTAMP_NTZ '2020-01-01 00:00:00' AS decision_date")
    good, bad = legal.two_stage(docs).orderBy("id").collect()
    assert good.stage1_score >= 17 and good.structure_score >= 40 and good.metadata_score == 50 and good.status in ("review_required", "approved")
    assert bad.stage1_score == 0 and bad.status == "rejected" and bad.context_score is None
    assert legal.pass_rates(legal.two_stage(docs)).first().stage1_rate == 50.0


def test_anonymised(spark):
    text = "Herr Max Muster, max@example.org, wohnt in 12345 Berlin, geboren 01.02.1980. Frau Erika Muster. Muster Werke GmbH, Hauptstraße 5."
    got = one(spark, text, anonymise.anonymised)
    assert "[Person 1]" in got.text and "[Person 2]" in got.text and "[EMAIL]" in got.text and "[PLZ ORT]" in got.text and "[GEBURTSDATUM]" in got.text and "[ADRESSE]" in got.text
    assert "Max" not in got.text and set(got.kinds.values()) == {"PERSON", "ORGANIZATION"}
    assert one(spark, None, anonymise.anonymised).text == ""


def test_scalars(spark):
    assert one(spark, "Größe,  & Maß!", scalars.normalized) == "größe maß"
    assert one(spark, "fine of EUR 200.000,50", scalars.fine_eur) == 20000050
    assert one(spark, "AP (Italy) - 12/2020", scalars.title_parts).country == "Italy"
    assert one(spark, "2020-05-01T10:00:00+02:00", scalars.parsed_date).year == 2020
    assert one(spark, "13.07.2021", scalars.parsed_date).month == 7
    assert one(spark, "https://x.org/w?a=1&title=B&c=2", scalars.normal_url) == "https://x.org/w?title=B"
    assert one(spark, "Das Urteil ist rechtskräftig.", scalars.finality) == "rechtskraeftig"
    assert one(spark, " 12 ", lambda c: scalars.typed(F.trim(c))).int == 12
    assert one(spark, "n/a", scalars.typed) == (None, None, None, None)


def test_sections(spark):
    text = "Urteil\nLeitsatz:\nDie Einwilligung muss freiwillig sein.\n\n\n\nMehr.\nTenor:\nDie Klage wird abgewiesen; Kosten trägt sie.\nTatbestand\nkurz\nGründe:\nDie Klage ist nicht begründet, weil\n- 12 -\nnichts folgt."
    got = one(spark, text, sections.sections)
    assert got.leitsatz == "Die Einwilligung muss freiwillig sein.\n\nMehr." and got.tenor.startswith("Die Klage wird") and got.tatbestand is None
    assert got.entscheidungsgruende == "Die Klage ist nicht begründet, weil\nnichts folgt."
    assert one(spark, None, sections.sections) == (None, None, None, None, "unbekannt")
    numbered = one(spark, "I. Sachverhalt und mehr\nDer Kläger verlangt Auskunft von ihr.\nII. Gründe\nEs besteht ein Anspruch auf Auskunft.\nIII. Kosten\nDie Kosten trägt die Beklagte.", sections.sections)
    assert numbered.tatbestand == "und mehr\nDer Kläger verlangt Auskunft von ihr." and numbered.entscheidungsgruende == "Es besteht ein Anspruch auf Auskunft."
    head = one(spark, "OLG Hamm, 3 U 12/20, Urteil vom 15.03.2024", sections.head_data)
    assert (head.docket, head.date, head.court) == ("3 U 12/20", "15.03.2024", "OLG Hamm")


def test_swiss(spark):
    assert one(spark, "Art. 8 DSG und Art. 6 DSGVO", swiss.references) == ["Art. 6 DSGVO", "DSG Art. 8"]
    assert one(spark, "Art. 6 DSGVO", lambda c: swiss.references(c, whole_words=False)) == ["Art. 6 DSGVO", "DSG Art. 6"]
    none = F.lit(None).cast("string")
    assert one(spark, "Das Tribunal fédéral", lambda c: swiss.court_of(none, c, F.lit("ZH"))) == "Bundesgericht"
    assert one(spark, "nichts", lambda c: swiss.court_of(none, c, F.lit("ZH"))) == "Kantonsgericht ZH"
    assert one(spark, "Personendaten nach DSG", lambda c: swiss.relevance(c, none, none, none, F.lit("Datenschutzrecht"), F.lit("Bundesgericht"))) == 22


def test_derived(spark):
    assert one(spark, "/x/../y", derived.attack) == "path_traversal" and one(spark, "/ok", derived.attack) is None
    assert one(spark, "13.07.2021", lambda c: derived.first_date(F.lit("x"), c)).year == 2021
    assert one(spark, "", lambda c: derived.title(c, c, c, c)) == "Unbenannte Entscheidung"
    assert one(spark, "Nach der DSGVO", lambda c: derived.relevant(F.array().cast("array<string>"), c))
    assert one(spark, "pending_stage1", lambda c: derived.decided(c, F.lit(90))) == "pending_stage1"


def test_literals_change_no_match(spark):
    """What a pattern finds is the same with the search for its literal in front, in all spellings."""
    pieces = ["DSGVO", "dsgvo", "Datenschutz-Grundverordnung", "Art. 6", "§ 26 BDSG", "Verarbeitung", "personenbezogener", "Daten", "\n", "BfDI", "Recht auf Vergessenwerden", "Bußgeld", "BUSSGELD", "Löschungsanspruch", "EUR 5", "Auſkunft", "privacy by design", "x", "Einwilligung", "datenverarbeitung", "BDSG n.F."]
    rng = random.Random(8)
    texts = [(" ".join(rng.choice(pieces) for _ in range(rng.randrange(1, 7))),) for _ in range(150)] + [("",), (None,)]
    patterns = [p for _, group in legal.RELEVANCE + legal.STAGE1 for p in group] + [p for group in [*legal.CONTEXT, legal.AGAINST] for p in group]
    df = spark.createDataFrame(texts, "t string")
    got = df.select(*(F.coalesce(legal.found(F.col("t"), p), F.lit(False)).alias(f"g{k}") for k, p in enumerate(patterns)), *(F.coalesce(F.col("t").rlike(legal.FLAGS + p), F.lit(False)).alias(f"w{k}") for k, p in enumerate(patterns))).collect()
    n = len(patterns)
    assert all(r[:n] == r[n:] for r in got) and sum(map(sum, (r[:n] for r in got))) > 300


def test_reasons(spark):
    docs = spark.createDataFrame([("1", "Mietvertrag", "nichts", "AG Bonn"), ("2", "DSGVO", "Datenschutz", "AG Bonn")], "id string, title string, content string, court string").selectExpr("*", "'1 K 1/20' AS case_number", "TIMESTAMP_NTZ '2020-01-01 00:00:00' AS decision_date")
    rows = legal.two_stage(docs).orderBy("id").collect()
    assert [r.rejection_reason for r in rows] == ["Stage 1 Score zu niedrig: 0", f"Confidence zu niedrig: {rows[1].confidence:.1f}%"]
    sure = legal.two_stage(docs, legal.FilterConfig(review_from=5.0)).orderBy("id").collect()[1]
    assert sure.status == legal.REVIEW_REQUIRED and sure.rejection_reason is None


def test_guards_lose_no_match(spark):
    """Patterns behind their words find what they find without, with odd letters too."""
    patterns = [*(p for group in legal.CONTEXT for p in group), *legal.AGAINST, *(p for _, ps in (*legal.STAGE1, *legal.RELEVANCE) for p in ps), "<h[1-4]>.*?(?:Gründe|Entscheidungsgründe).*?</h[1-4]>"]
    texts = ["eİnwillIgung", "Buſſgeld Daten, Bußgeld EUR 5", "Löſchung angeordnet", "unbefugt verarbeitet", "ohne Einwilligung erhoben", "ohne\tEinwilligung erhoben", "Zustimmung fehlt", "RECHT AUF AUSKUNFT", "Artikel 6 Absatz 1 GDPR", "Art 6 der Verordnung", "DSK", "\u212aein DSGVO", "<h1>GRÜNDE</h1>", "Daten Vorfall", "Transparenz", ""]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    both = df.select("t", *(F.array(legal.found(F.col("t"), p), F.col("t").rlike(legal.FLAGS + p)).alias(f"p{k}") for k, p in enumerate(patterns)))
    rows = both.collect()
    assert [(r.t, patterns[k]) for r in rows for k in range(len(patterns)) if r[k + 1][0] != r[k + 1][1]] == [] and sum(r[k + 1][0] for r in rows for k in range(len(patterns))) > 15
    assert legal.needed("(?:ohne Einwilligung|x).*?Daten(?:schutz)?") == (("daten",), ("ohne einwilligung", "x")) and legal.needed("a|[bc]") == () and legal.needed("(?:a|b)?c") == (("c",),)


def test_two_stage_lowers_a_text_twice(spark):
    df = spark.createDataFrame([("a", "b", "c", "d", None)], "title string, content string, court string, case_number string, decision_date timestamp_ntz")
    plan = legal.two_stage(df)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("lower(content") + plan.count("lower(coalesce(content") + plan.count("lower(__") + plan.count("lower(concat_ws") <= 2
