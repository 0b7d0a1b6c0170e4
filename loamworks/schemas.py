"""Record schemas."""

from __future__ import annotations

from pyspark.sql import types as T


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


_S, _AS, _INT, _LONG = T.StringType(), T.ArrayType(T.StringType()), T.IntegerType(), T.LongType()

CHUNK = _struct(source=_S, chunk=_INT, text=_S, approx_tokens=_LONG)
PAIR = _struct(instruction=_S, output=_S, source=_S, chunk=_INT)
ALPACA = _struct(instruction=_S, input=_S, output=_S, source=_S, chunk=_INT)
CHAT = _struct(messages=T.ArrayType(_struct(role=_S, content=_S)))
REPLY_PAIRS = _struct(pairs=T.ArrayType(_struct(instruction=_S, output=_S)))

#: What a structured mode's reply holds, by mode.
STRUCTURED = {
    "knowledge-base": _struct(main_topic=_S, summary=_S, key_facts=_AS, key_concepts=T.ArrayType(_struct(term=_S, definition=_S)), connections_to_other_topics=_AS, questions_raised=_AS),
    "academic-research": _struct(hypothesis=_S, research_type=_S, methodology=_S, sample_and_data=_S, findings=_S, key_figures=_AS, citations=_AS, limitations=_S, future_research=_S),
    "student-summary": _struct(title=_S, difficulty_level=_S, one_liner=_S, summary=_S, key_points=_AS, definitions=T.ArrayType(_struct(term=_S, definition=_S))),
    "analytics": _struct(document_type=_S, key_metrics=T.ArrayType(_struct(metric=_S, value=_S, context=_S)), trends=_AS, patterns=_AS, anomalies=_AS, data_sources=_AS, insights=_AS, visualizable_data=T.ArrayType(_struct(label=_S, values=_AS))),
}

#: The JSON schema that pair replies are held to.
PAIRS_JSON_SCHEMA = {
    "type": "object",
    "required": ["pairs"],
    "additionalProperties": False,
    "properties": {
        "pairs": {
            "type": "array",
            "items": {"type": "object", "required": ["instruction", "output"], "additionalProperties": False, "properties": {"instruction": {"type": "string"}, "output": {"type": "string"}}},
        }
    },
}
