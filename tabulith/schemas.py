"""Schemas of the files that the engine reads; none is inferred."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _B = T.StringType(), T.BooleanType()


def _struct(**fields) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


SECTION = _struct(label=_S, heading=_S, kind=_S, text=_S)
DOCUMENT = _struct(id=_S, title=_S, kind=_S, aliases=T.ArrayType(_S), sections=T.ArrayType(SECTION))
PAPER_TABLE = _struct(number=T.IntegerType(), label=_S, caption=_S, rows=T.ArrayType(_S), foot=_S)
PARAGRAPH = _struct(section=_S, text=_S)
PAPER = _struct(id=_S, title=_S, tables=T.ArrayType(PAPER_TABLE), paragraphs=T.ArrayType(PARAGRAPH))
SOURCE = _struct(id=_S, title=_S, text=_S)
ITEM = _struct(id=_S, dataset=_S, claim=_S, citation=_S, targetId=_S, label=_S, errorType=_S, goldSentences=T.ArrayType(T.IntegerType()), sourcePaper=_S, mutation=_S, originalClaim=_S, reviewed=_B, note=_S)
RESULT = _struct(verdict=_S, quote=_S, location=_S, reason=_S, suggestedLocation=_S, confidence=_S)
USAGE = _struct(promptTokens=T.LongType(), completionTokens=T.LongType(), costUsd=T.DoubleType())
FAILURE = _struct(code=_S, message=_S)
ATTEMPT = _struct(result=RESULT, failures=T.ArrayType(FAILURE))
STEP = _struct(tool=_S, args=T.MapType(_S, _S), outputChars=T.LongType(), error=_S, attempt=T.IntegerType())
TRACE = _struct(steps=T.ArrayType(STEP), toolCalls=T.IntegerType(), llmTurns=T.IntegerType(), budgetExhausted=_B, peakPromptTokens=T.LongType(), attempts=T.ArrayType(ATTEMPT))
HYBRID = _struct(decidedBy=_S, fastResult=RESULT, fastLatencyMs=T.LongType(), escalationReason=_S)
RECORD = _struct(item=ITEM, model=_S, agent=_S, result=RESULT, error=_S, quoteGrounded=_B, usage=USAGE, latencyMs=T.LongType(), trace=TRACE, resolution=_S, cues=_S, warning=_S, hybrid=HYBRID)
OVERRIDE = _struct(id=_S, label=_S, category=_S, status=_S, note=_S, claim=_S, citation=_S)
REPLY = "verdict string, quote string, location string, reason string, suggestedLocation string, confidence string"
