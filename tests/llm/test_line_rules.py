"""The quality stage keeps long lines that mention a phrase, and sentences of any script."""

import corpus_pipeline
from tests.llm.test_queries import SCHEMA


def test_long_lines_and_other_scripts_stay(spark):
    words = " ".join(f"word{i} is one of many." for i in range(400))
    hindi = "यह एक साफ वाक्य है जो यहाँ पूरा होता है। यह दूसरा वाक्य भी यहीं पर पूरा होता है।"
    urdu = "یہ ایک صاف جملہ ہے جو یہاں ختم ہوتا ہے۔ یہ دوسرا جملہ بھی یہاں ختم ہوتا ہے۔"
    arabic = "هل هذا سؤال واضح ومكتوب بشكل جيد هنا في هذا السطر الطويل جدا؟"
    texts = [f"{words} It is powered by wind. {words.replace('word', 'term')}", hindi, urdu, arabic]
    footer = "This site is powered by Example. All rights reserved."
    docs = list(enumerate([*texts, f"{words}\n{footer}"]))
    out = dict(corpus_pipeline.STAGES)["quality"](spark, spark.createDataFrame(docs, SCHEMA), "")
    assert {r.doc_id: r.text for r in out.collect()} == dict(enumerate([*texts, words]))
