"""What becomes of each attribute and element of a Showplan XML document; scope:X descends into scope X.

("if", label, a, b) is a where the element has the label, else b.
"""


def _all(treatment: str, labels: str) -> dict[str, str]:
    return dict.fromkeys(labels.split(), treatment)


# Label and treatment, element by element.
SQLSERVER = {
    "showplan": {
        "xmlns": "showplan_namespace",
        "xmlns:xsi": "schema_namespace",
        "xmlns:xsd": "schema_namespace",
        "Version": "version",
        "Build": "version",
        "BatchSequence": "scope:batch_sequence",
    },
    "batch_sequence": {"Batch": "scope:batch"},
    "batch": {"Statements": "scope:statements"},
    "statements": {"StmtSimple": "scope:statement"},
    "statement": {
        **_all("masked", "StatementText ParameterizedText QueryHash QueryPlanHash ParameterizedPlanHandle"),
        **_all("measured", "StatementId StatementCompId StatementEstRows StatementSubTreeCost"),
        **_all("enum", "StatementType StatementOptmLevel StatementOptmEarlyAbortReason"),
        "CardinalityEstimationModelVersion": "version",
        **_all("xml_boolean", "RetrievedFromCache SecurityPolicyApplied"),
        "StatementSetOptions": "scope:set_options",
        "QueryPlan": "scope:query_plan",
    },
    "set_options": _all("xml_boolean", "ANSI_NULLS ANSI_PADDING ANSI_WARNINGS ARITHABORT CONCAT_NULL_YIELDS_NULL NUMERIC_ROUNDABORT QUOTED_IDENTIFIER"),
    "query_plan": {
        **_all("measured", "DegreeOfParallelism MemoryGrant CachedPlanSize CompileTime CompileCPU CompileMemory"),
        "NonParallelPlanReason": "enum",
        "ContainsInterleavedExecutionCandidates": "xml_boolean",
        "MemoryGrantInfo": "scope:memory_grant",
        "OptimizerHardwareDependentProperties": "scope:hardware",
        "OptimizerStatsUsage": "scope:stats_usage",
        "TraceFlags": "scope:trace_flags",
        "ParameterList": "scope:columns",
        "Warnings": "scope:warnings",
        "RelOp": "scope:rel_op",
    },
    "memory_grant": _all("measured", "SerialRequiredMemory SerialDesiredMemory RequiredMemory DesiredMemory RequestedMemory GrantWaitTime GrantedMemory MaxUsedMemory"),
    "hardware": _all("measured", "EstimatedAvailableMemoryGrant EstimatedPagesCached EstimatedAvailableDegreeOfParallelism MaxCompileMemory"),
    "stats_usage": {"StatisticsInfo": "scope:statistics"},
    "statistics": {
        "Database": "bracketed:SCHEMA",
        "Schema": "bracketed:SCHEMA",
        "Table": "bracketed:TABLE",
        "Statistics": "bracketed:INDEX",
        **_all("measured", "ModificationCount SamplingPercent LastUpdate"),
    },
    "trace_flags": {"IsCompileTime": "xml_boolean", "TraceFlag": "scope:trace_flag"},
    "trace_flag": {"Value": "count", "Scope": "enum"},
    "columns": {"ColumnReference": "scope:column"},
    "column": {
        "Database": "bracketed:SCHEMA",
        "Schema": "bracketed:SCHEMA",
        "Table": "bracketed:TABLE",
        "Alias": "bracketed_alias",
        "Column": ("if", "Table", "name:COLUMN", "masked"),
        "ComputedColumn": "xml_boolean",
        "ParameterDataType": "data_type",
        "ParameterCompiledValue": "bracketed_expression",
        "ParameterRuntimeValue": "bracketed_expression",
    },
    "scalars": {"ScalarOperator": "scope:scalar"},
    "scalar": {
        "ScalarString": "bracketed_expression",
        "Identifier": "scope:columns",
        "Const": "scope:const",
        "Compare": "scope:compare",
        "Convert": "scope:convert",
        "Arithmetic": "scope:operation",
        "Logical": "scope:operation",
        "Aggregate": "scope:aggregate",
        "Intrinsic": "scope:intrinsic",
    },
    "const": {"ConstValue": "bracketed_expression"},
    "compare": {"CompareOp": "enum", "ScalarOperator": "scope:scalar"},
    "convert": {"DataType": "data_type", **_all("count", "Length Precision Scale"), "Style": "measured", "Implicit": "xml_boolean", "ScalarOperator": "scope:scalar"},
    "operation": {"Operation": "enum", "ScalarOperator": "scope:scalar"},
    "aggregate": {"AggType": "enum", "Distinct": "xml_boolean", "ScalarOperator": "scope:scalar"},
    "intrinsic": {"FunctionName": "token", "ScalarOperator": "scope:scalar"},
    "warnings": {"PlanAffectingConvert": "scope:convert_warning", "SpillToTempDb": "scope:spill", "ColumnsWithNoStatistics": "scope:columns"},
    "convert_warning": {"ConvertIssue": "enum", "Expression": "bracketed_expression"},
    "spill": _all("measured", "SpillLevel SpilledThreadCount"),
    "rel_op": {
        **_all("measured", "NodeId EstimateRows EstimateIO EstimateCPU AvgRowSize EstimatedTotalSubtreeCost TableCardinality EstimateRebinds EstimateRewinds EstimateRowsWithoutRowGoal"),
        **_all("enum", "PhysicalOp LogicalOp EstimatedExecutionMode"),
        "Parallel": "xml_boolean",
        "OutputList": "scope:columns",
        "Warnings": "scope:warnings",
        "RelOp": "scope:rel_op",
        "IndexScan": "scope:index_scan",
        "TableScan": "scope:table_scan",
        "NestedLoops": "scope:nested_loops",
        "Hash": "scope:hash",
        "Sort": "scope:ss_sort",
        "ComputeScalar": "scope:compute_scalar",
        "Filter": "scope:filter",
        "StreamAggregate": "scope:stream_aggregate",
        "Top": "scope:top",
    },
    "index_scan": {
        **_all("xml_boolean", "Ordered ForcedIndex ForceSeek ForceScan NoExpandHint Lookup"),
        **_all("enum", "ScanDirection Storage"),
        "DefinedValues": "scope:defined_values",
        "Object": "scope:object",
        "SeekPredicates": "scope:seek_predicates",
        "Predicate": "scope:scalars",
    },
    "table_scan": {**_all("xml_boolean", "Ordered ForcedIndex ForceScan NoExpandHint"), "Storage": "enum", "DefinedValues": "scope:defined_values", "Object": "scope:object", "Predicate": "scope:scalars"},
    "object": {
        "Database": "bracketed:SCHEMA",
        "Schema": "bracketed:SCHEMA",
        "Table": "bracketed:TABLE",
        "Index": "bracketed:INDEX",
        "Alias": "bracketed_alias",
        "IndexKind": "enum",
        "Storage": "enum",
        "TableReferenceId": "measured",
        "CloneAccessScope": "enum",
    },
    "seek_predicates": {"SeekPredicateNew": "scope:seek_predicate", "SeekPredicate": "scope:seek_key"},
    "seek_predicate": {"SeekKeys": "scope:seek_key"},
    "seek_key": _all("scope:seek_range", "Prefix StartRange EndRange IsNotNull"),
    "seek_range": {"ScanType": "enum", "RangeColumns": "scope:columns", "RangeExpressions": "scope:scalars"},
    "defined_values": {"DefinedValue": "scope:defined_value"},
    "defined_value": {"ColumnReference": "scope:column", "ScalarOperator": "scope:scalar"},
    "nested_loops": {
        **_all("xml_boolean", "Optimized WithOrderedPrefetch WithUnorderedPrefetch"),
        "OuterReferences": "scope:columns",
        "Predicate": "scope:scalars",
        "DefinedValues": "scope:defined_values",
        "RelOp": "scope:rel_op",
    },
    "hash": {
        "BitmapCreator": "xml_boolean",
        "DefinedValues": "scope:defined_values",
        "HashKeysBuild": "scope:columns",
        "HashKeysProbe": "scope:columns",
        "ProbeResidual": "scope:scalars",
        "RelOp": "scope:rel_op",
    },
    "ss_sort": {"Distinct": "xml_boolean", "DefinedValues": "scope:defined_values", "OrderBy": "scope:order_by", "RelOp": "scope:rel_op"},
    "order_by": {"OrderByColumn": "scope:order_by_column"},
    "order_by_column": {"Ascending": "xml_boolean", "ColumnReference": "scope:column"},
    "compute_scalar": {"ComputeSequence": "xml_boolean", "DefinedValues": "scope:defined_values", "RelOp": "scope:rel_op"},
    "filter": {"StartupExpression": "xml_boolean", "DefinedValues": "scope:defined_values", "Predicate": "scope:scalars", "RelOp": "scope:rel_op"},
    "stream_aggregate": {"DefinedValues": "scope:defined_values", "GroupBy": "scope:columns", "RelOp": "scope:rel_op"},
    "top": {**_all("xml_boolean", "RowCount IsPercent WithTies"), "Rows": "measured", "TopExpression": "scope:scalars", "DefinedValues": "scope:defined_values", "RelOp": "scope:rel_op"},
}
