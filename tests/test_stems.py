"""English stems against fixed values, and comment search over inflections."""

import pytest
from pyspark.sql import functions as F

from brinelog.functions.stems import stem
from brinelog.operators import tags

EXPECTED = """caresses caress, ponies poni, ties tie, cries cri, cats cat, gas gas, this this, kiwis kiwi, gaps gap, feed feed, agreed agre, plastered plaster,
bled bled, motoring motor, sing sing, conflated conflat, troubled troubl, sized size, hopping hop, hoping hope, falling fall, hissing hiss, filing file,
happy happi, sky sky, cry cri, by by, say say, relational relat, conditional condit, rational ration, valency valenc, digitizer digit, vietnamization vietnam,
predication predic, operator oper, feudalism feudal, decisiveness decis, hopefulness hope, callousness callous, formality formal, sensitivity sensit,
sensibility sensibl, triplicate triplic, formative format, formalize formal, electrical electr, goodness good, revival reviv, allowance allow, inference infer,
airliner airlin, adjustable adjust, defensible defens, replacement replac, adjustment adjust, dependent depend, adoption adopt, communism communism,
activate activ, homologous homolog, effective effect, probate probat, rate rate, cease ceas, controlling control, rolling roll, generously generous,
general general, skis ski, dying die, news news, succeeding succeed, exceedingly exceed, yields yield, enjoying enjoy, knightly knight, beautifully beauti,
consistently consist, consigned consign, knocks knock, ability abil, licenses licens, licensing licens, diatoms diatom, measured measur""".replace("\n", " ")


@pytest.mark.parametrize("pair", EXPECTED.split(", "))
def test_fixed_values(pair):
    word, want = pair.split()
    assert stem(word) == want


def test_search_takes_every_inflection(spark):
    rows = [(1, "Dividing diatoms were measured."), (2, "one diatom, a measure of it"), (3, "diatoms only"), (4, "MEASURING Diatom-like cells"), (5, None), (6, ""),
            (7, "diatomite measures"), (8, "the and of")]
    comments = spark.createDataFrame(rows, "id long, comment string").withColumn("bin_id", F.col("id") * 10)

    def found(text):
        return sorted(r.id for r in tags.search_comments(comments, text).collect())

    assert found("the diatoms measure") == [1, 2, 4]
    assert found("measuring") == [1, 2, 4, 7]
    assert found("the of") == [] == found("") == found("absent diatom")
    bins = spark.createDataFrame([(10, "north"), (40, "south")], "id long, ts_label string")
    assert [r.id for r in tags.search_comments(comments, "diatom", bins, "south").collect()] == [4]
