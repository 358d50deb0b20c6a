"""Schemas of the records that the plans exchange."""

INSTRUCTION = "struct<address: bigint, mnemonic: string, disassembly: string>"
BLOCK = f"struct<start_ea: bigint, end_ea: bigint, instructions: array<{INSTRUCTION}>, successors: array<bigint>, predecessors: array<bigint>>"
CODE_FEATURES = "struct<code: array<struct<id: int, asm: string>>, data_dep: array<struct<use_id: int, def_id: int>>>"

SOURCE_FUNCTION = "project_name string, file_path string, function_name string, source_code string, comment string"
DISASSEMBLED = f"struct<function_name: string, start_ea: bigint, end_ea: bigint, decompiled_code: string, cfg: map<string, {BLOCK}>, callees: map<string, bigint>, callers: map<string, bigint>, word_count: int>"
CANDIDATE = "fn_id string, probed_sources array<string>, signatures array<string>, confidence_scores array<double>"
PATHS = "fn_id string, path array<array<bigint>>"
SUMMARY = "fn_id string, generation_mode string, generated_summary string, reference string, source_code string"
