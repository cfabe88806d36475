"""What becomes of each field of a MySQL plan document, version 2 and version 1; scope:X descends into scope X."""

# Label and treatment, scope by scope.
MYSQL = {
    "mysql2": {
        "query": "masked",
        "inputs": "scope:mysql2_node",
        "json_schema_version": "version",
    },
    "mysql2_node": {
        "operation": "rendered",
        "table_name": "name:TABLE",
        "schema_name": "name:SCHEMA",
        "index_name": "name:INDEX",
        "sort_key": "reference:SCHEMA.TABLE.COLUMN",
        "access_type": "token",
        "index_access_type": "token",
        "join_algorithm": "token",
        "join_type": "token",
        "covering": "boolean",
        "condition": "masked",
        "lookup_condition": "masked",
        "hash_condition": "masked",
        "index_range": "masked",
        "aggregate_function": "masked",
        "estimated_rows": "measured",
        "estimated_total_cost": "measured",
        "estimated_first_row_cost": "measured",
        "actual_rows": "measured",
        "actual_loops": "measured",
        "actual_first_row_ms": "measured",
        "actual_last_row_ms": "measured",
        "rows_per_scan": "measured",
        "limit_rows": "measured",
        "heap_usage_bytes": "measured",
        "inputs": "scope:mysql2_node",
        "subqueries": "scope:mysql2_node",
        "materialized_from_subquery": "scope:mysql2_node",
    },
    "mysql1": {
        "query_block": "scope:mysql1_block",
    },
    "mysql1_block": {
        "select_id": "measured",
        "cost_info": "scope:mysql1_cost",
        "table": "scope:mysql1_table",
        "message": "listed:messages",
        "using_filesort": "boolean",
        "using_temporary_table": "boolean",
        "cacheable": "boolean",
        "dependent": "boolean",
        "nested_loop": "scope:mysql1_block",
        "ordering_operation": "scope:mysql1_block",
        "grouping_operation": "scope:mysql1_block",
        "duplicates_removal": "scope:mysql1_block",
        "attached_subqueries": "scope:mysql1_block",
        "materialized_from_subquery": "scope:mysql1_block",
        "query_specifications": "scope:mysql1_block",
        "query_block": "scope:mysql1_block",
        "union_result": "scope:mysql1_union",
    },
    "mysql1_union": {
        "table_name": "masked",
        "access_type": "listed:accesses",
        "using_temporary_table": "boolean",
        "query_specifications": "scope:mysql1_block",
    },
    "mysql1_table": {
        "table_name": "name:TABLE",
        "key": "name:INDEX",
        "possible_keys": "name:INDEX",
        "key_length": "listed:lengths",
        "access_type": "listed:accesses",
        "message": "listed:messages",
        "used_columns": "reference:COLUMN",
        "used_key_parts": "reference:COLUMN",
        "partitions": "masked",
        "attached_condition": "masked",
        "index_condition": "masked",
        "ref": "masked",
        "using_index": "boolean",
        "using_temporary_table": "boolean",
        "using_filesort": "boolean",
        "rows_examined_per_scan": "measured",
        "rows_produced_per_join": "measured",
        "filtered": "measured",
        "cost_info": "scope:mysql1_cost",
        "materialized_from_subquery": "scope:mysql1_block",
        "attached_subqueries": "scope:mysql1_block",
    },
    "mysql1_cost": {
        "query_cost": "measured",
        "read_cost": "measured",
        "eval_cost": "measured",
        "prefix_cost": "measured",
        "data_read_per_join": "measured",
        "sort_cost": "measured",
    },
}
