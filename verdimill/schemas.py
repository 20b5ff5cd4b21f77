"""Schemas of the engine's own tables, as DDL strings."""

from __future__ import annotations

#: Probabilities are arrays sorted by key: order and exactness survive, and arrays compare and union.
PROBS = "array<struct<key:string,p:double>>"
ANSWER = f"struct<type:string,noul:double,choice:string,score:double,confidence:double,probs:{PROBS},legend:array<struct<key:string,label:string>>,raw:string,decode_error:string>"
PART = "struct<n:int,of:int,lines:string,size:int>"
ITEM = "item_index bigint, label string, unit string, value string, state string, parts array<struct<lines:string,size:int,state:string>>, media struct<content_type:string,path:string>, is_diff boolean, is_code boolean"
REQUEST = f"index bigint, item_first bigint, source string, part {PART}, value string, state string"
RESULT = f"index bigint, attempt_seq bigint, source string, part {PART}, input string, status string, answers map<string,{ANSWER}>, model string, request_id string, cached array<string>, error string"
CONDITION = "question string, kind string, answer string, op string, value double"
CACHE = "key string, answer string, time_ns bigint, segment_seq bigint, version string"
