"""Statements of the document's silence: what stays, what goes, and where."""

from pyspark.sql import functions as F

from quillstone.operators import silences as S

ASKED = "Is there financial aid for international students in 1847?"
STAYS = [
    "However, the document does not state whether international students get financial aid.", "The excerpts do not mention financial aid.", "The document does not say so.", "It does not specify the aid.",
    "There is no information about financial aid for students.", "It is not stated in the document whether international students get aid.", "The document doesn't explicitly mention international student aid.", "Unfortunately, the uploaded pages do not address financial aid.",
    "Cependant, le document ne mentionne pas financial aid.", "El documento no especifica si international students.", "Das Dokument erwähnt nicht international students.", "لا يذكر المستند financial aid.",
]
GOES = [
    "Students get financial aid.", "The document does not mention that refunds are impossible.", "The university does not offer financial aid.", "It does not provide financial aid.", "The document does not mention financial aid, but you should call.", "The document does not state whether students can live on campus with pets.",
    "The document does not mention financial aid; it is closed.", "Please note the document does not mention aid.", "The document does not mention aid, visit www.example.com.", "The document does not mention aid 18471234.", "The document does not mention " + "aid " * 40 + ".", "", None, "This suggests that the document does not say so directly.",
    "The document does not mention refunds or housing or pets.",
]


def test_silence(spark):
    rows = [(s, True) for s in STAYS] + [(s, False) for s in GOES]
    got = spark.createDataFrame(rows, "s string, want boolean").withColumn("got", S.is_silence(F.col("s"), F.lit(ASKED))).collect()
    assert [r.s for r in got if r.got != r.want] == []
    none = spark.createDataFrame([("The document does not say so.",), ("The document does not mention aid.",)], "s string").withColumn("got", S.is_silence(F.col("s"), F.lit(None).cast("string"))).collect()
    assert [r.got for r in none] == [True, False]


def test_two_after_a_citation(spark):
    silent = "The document does not mention financial aid."
    replies = [[silent, "Aid is old [S1].", "Made up.", silent, silent, silent, "More [S2]."], [silent, "Nothing cited."], [], None]
    got = spark.createDataFrame([(r,) for r in replies], "said array<string>").withColumn("got", S.kept(F.col("said"), F.lit(ASKED))).collect()
    assert [r.got for r in got] == [["Aid is old [S1].", silent, silent, "More [S2]."], [], [], None]
