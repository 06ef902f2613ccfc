"""Ordinary prose of the four languages is within its band; repeated and garbled text isn't."""

import pytest

from tidemark.llm import quality
from tidemark.llm.vocabularies import default_path

PROSE = {
    "en": "The city council voted on Tuesday to repair the old bridge over the river, which has been closed to heavy traffic since last winter. Engineers found cracks in two of the supporting columns during a routine inspection, and they warned that the damage would grow if nothing was done. The work will begin in the spring and is expected to take about eight months. Until then, drivers are asked to use the northern road, while cyclists and pedestrians may still cross.",
    "de": "Der Stadtrat hat am Dienstag beschlossen, die alte Brücke über den Fluss zu erneuern, die seit dem vergangenen Winter für schwere Fahrzeuge gesperrt ist. Fachleute hatten bei einer Prüfung Risse in zwei Pfeilern entdeckt und davor gewarnt, dass der Schaden größer wird, wenn nichts geschieht. Die Arbeiten beginnen im Frühjahr und dauern etwa acht Monate. Bis dahin sollen Autofahrer die nördliche Straße benutzen, während Fußgänger und Radfahrer die Brücke weiter überqueren dürfen.",
    "es": "El ayuntamiento decidió el martes reparar el viejo puente sobre el río, que está cerrado al tráfico pesado desde el invierno pasado. Los ingenieros encontraron grietas en dos de las columnas durante una inspección y advirtieron que los daños crecerían si no se hacía nada. Las obras empezarán en primavera y durarán unos ocho meses. Hasta entonces se pide a los conductores que utilicen la carretera del norte, mientras que los peatones todavía pueden cruzar.",
    "fr": "Le conseil municipal a décidé mardi de réparer le vieux pont sur la rivière, fermé aux véhicules lourds depuis l'hiver dernier. Les ingénieurs ont trouvé des fissures dans deux des piliers pendant une inspection et ont averti que les dégâts deviendraient plus graves si rien n'était fait. Les travaux commenceront au printemps et dureront environ huit mois. Jusque-là, les automobilistes doivent emprunter la route du nord, tandis que les piétons peuvent encore traverser.",
}


@pytest.mark.parametrize("lang", sorted(PROSE))
def test_prose_is_kept(spark, lang):
    words = PROSE[lang].split()
    garbled = " ".join("\u0378\u0379" + w[::-1] for w in words)
    rows = [(0, PROSE[lang]), (1, " ".join(words[:55])), (2, " ".join(words[:9] * 9)), (3, garbled)]
    docs = spark.createDataFrame([(i, t, lang) for i, t in rows], "doc_id long, text string, lang string")
    assert {r["doc_id"] for r in quality.quality_filter(docs).collect()} == {0, 1}


def test_licence_texts_are_kept():
    from pathlib import Path

    folder = Path("/usr/share/common-licenses")
    if not folder.is_dir():
        pytest.skip("no licence texts")
    fertility = quality.Fertility(open(default_path("piece_bpe_32k.model"), "rb").read())
    for path in folder.iterdir():
        text = path.read_text(errors="replace")
        if len(text.split()) >= 50:
            _, chars, share, entropy = fertility.measure(" ".join(text.split()))
            assert quality.within(quality.BANDS["en"], len(text.split()), chars, share, entropy), path
