from cellgrid.llm.languages import NAMES, learn, sampled

SAID = {
    "en": "The document does not state this value", "fr": "Le document ne précise pas cette valeur", "de": "Das Dokument enthält dazu keine genaue Angabe", "ru": "Согласно разделу 4.12, урожай пшеницы вырос",
    "es": "La respuesta a esta pregunta no está en las páginas", "el": "Σύμφωνα με την ενότητα 2.15, ο χρόνος", "ja": "2007年に燃料の消費が992単位だったと報告した。", "it": "Secondo la sezione 3 il consumo di acqua è cresciuto molto",
    "nl": "De kosten van het water zijn in dit jaar sterk gestegen", "pt": "Segundo o capítulo 3 o consumo de água aumentou muito", "zh": "根据第三章用水量大幅增加", "pl": "Zużycie wody w tym roku znacznie wzrosło",
}


def test_languages_from_the_samples():
    for k, t in SAID.items():
        assert sampled().language(t) == k, (k, t)
    for t in ("Kouplamskiav-Biarstaeson, 12", "", "287.4 m²", "Ok", "...", "42"):
        assert sampled().language(t) == ""
    assert sampled().language("THE DOCUMENT DOES NOT STATE THIS VALUE") == "en"


def test_learning_from_labels(spark):
    rows = [("zzorp qlimmer vrendik gostaw plurnik", "it-IT")] * 30 + [("the value of the table", "EN")] * 30 + [("the the", None), (None, "en"), ("x", "??"), ("", "en")]
    m = learn(spark.createDataFrame([(*r, 1) for r in rows], "text string, lang string, n int"))
    assert sampled().language("qlimmer vrendik plurnik gostaw") != "it" == m.language("qlimmer vrendik plurnik gostaw")
    assert m.texts[NAMES.index("it")] == 30 and m.texts[NAMES.index("en")] == 31
    assert m.language(SAID["nl"]) == "nl" and m.language("the value") == ""
    assert learn(spark.createDataFrame([], "text string, lang string")).language(SAID["en"]) == "en"
