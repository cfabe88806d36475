"""What becomes of each field of a PostgreSQL plan document; scope:X descends into scope X."""

# Label and treatment, scope by scope.
BUFFERS = {
    "Shared Hit Blocks": "measured",
    "Shared Read Blocks": "measured",
    "Shared Dirtied Blocks": "measured",
    "Shared Written Blocks": "measured",
    "Local Hit Blocks": "measured",
    "Local Read Blocks": "measured",
    "Local Dirtied Blocks": "measured",
    "Local Written Blocks": "measured",
    "Temp Read Blocks": "measured",
    "Temp Written Blocks": "measured",
    "I/O Read Time": "measured",
    "I/O Write Time": "measured",
    "Shared I/O Read Time": "measured",
    "Shared I/O Write Time": "measured",
    "Local I/O Read Time": "measured",
    "Local I/O Write Time": "measured",
    "Temp I/O Read Time": "measured",
    "Temp I/O Write Time": "measured",
    "WAL Records": "measured",
    "WAL FPI": "measured",
    "WAL Bytes": "measured",
    "WAL Buffers Full": "measured",
}
POSTGRES = {
    "query": {
        "Plan": "scope:plan",
        "Query Text": "masked",
        "Query Identifier": "masked",
        "Query Parameters": "parameters",
        "Planning": "scope:buffers",
        "Planning Time": "measured",
        "Execution Time": "measured",
        "Total Runtime": "measured",
        "Triggers": "scope:trigger",
        "JIT": "scope:jit",
        "Settings": "settings",
    },
    "buffers": {
        **BUFFERS,
    },
    "plan": {
        "Relation Name": "name:TABLE",
        "Function Name": "name:TABLE",
        "Schema": "name:SCHEMA",
        "Index Name": "name:INDEX",
        "Conflict Arbiter Indexes": "name:INDEX",
        "Alias": "declared",
        "CTE Name": "declared",
        "Tuplestore Name": "declared",
        "Subplan Name": "declared",
        "Node Type": "enum",
        "Strategy": "enum",
        "Partial Mode": "enum",
        "Operation": "enum",
        "Join Type": "enum",
        "Scan Direction": "enum",
        "Parent Relationship": "enum",
        "Conflict Resolution": "enum",
        "Cache Mode": "enum",
        "Sampling Method": "enum",
        "Sort Method": "enum",
        "Sort Space Type": "enum",
        "Sort Methods Used": "enum",
        "Storage": "enum",
        "Parallel Aware": "boolean",
        "Async Capable": "boolean",
        "Inner Unique": "boolean",
        "Single Copy": "boolean",
        "Custom Plan Provider": "masked",
        "Remote SQL": "masked",
        "Output": "expression",
        "Filter": "expression",
        "Index Cond": "expression",
        "Recheck Cond": "expression",
        "TID Cond": "expression",
        "Join Filter": "expression",
        "Hash Cond": "expression",
        "Merge Cond": "expression",
        "One-Time Filter": "expression",
        "Conflict Filter": "expression",
        "Sort Key": "expression",
        "Presorted Key": "expression",
        "Group Key": "expression",
        "Hash Key": "expression",
        "Cache Key": "expression",
        "Function Call": "expression",
        "Order By": "expression",
        "Sampling Parameters": "expression",
        "Repeatable Seed": "expression",
        "Group Keys": "expression",
        "Hash Keys": "expression",
        "Startup Cost": "measured",
        "Total Cost": "measured",
        "Plan Rows": "measured",
        "Plan Width": "measured",
        "Actual Startup Time": "measured",
        "Actual Total Time": "measured",
        "Actual Rows": "measured",
        "Actual Loops": "measured",
        "Disabled Nodes": "measured",
        "Subplans Removed": "measured",
        "Rows Removed by Filter": "measured",
        "Rows Removed by Index Recheck": "measured",
        "Rows Removed by Join Filter": "measured",
        "Rows Removed by Conflict Filter": "measured",
        "Heap Fetches": "measured",
        "Exact Heap Blocks": "measured",
        "Lossy Heap Blocks": "measured",
        "Index Searches": "measured",
        "Sort Space Used": "measured",
        "Workers Planned": "measured",
        "Workers Launched": "measured",
        "Hash Buckets": "measured",
        "Original Hash Buckets": "measured",
        "Hash Batches": "measured",
        "Original Hash Batches": "measured",
        "Peak Memory Usage": "measured",
        "Disk Usage": "measured",
        "Cache Hits": "measured",
        "Cache Misses": "measured",
        "Cache Evictions": "measured",
        "Cache Overflows": "measured",
        "Maximum Storage": "measured",
        "Tuples Inserted": "measured",
        "Conflicting Tuples": "measured",
        "Tuples Updated": "measured",
        "Tuples Deleted": "measured",
        "Tuples Skipped": "measured",
        "Worker Number": "measured",
        "Plans": "scope:plan",
        "Plan": "scope:plan",
        "Workers": "scope:plan",
        "Worker": "scope:plan",
        "Grouping Sets": "scope:plan",
        "Grouping Set": "scope:plan",
        "JIT": "scope:jit",
        "Full-sort Groups": "scope:sort",
        "Pre-sorted Groups": "scope:sort",
        **BUFFERS,
    },
    "trigger": {
        "Trigger": "scope:trigger",
        "Trigger Name": "masked",
        "Constraint Name": "masked",
        "Relation": "name:TABLE",
        "Time": "measured",
        "Calls": "measured",
    },
    "jit": {
        "Worker Number": "measured",
        "Functions": "measured",
        "Options": "scope:options",
        "Timing": "scope:timing",
    },
    "options": {
        "Inlining": "boolean",
        "Optimization": "boolean",
        "Expressions": "boolean",
        "Deforming": "boolean",
    },
    "timing": {
        "Generation": "measured",
        "Inlining": "measured",
        "Optimization": "measured",
        "Emission": "measured",
        "Total": "measured",
    },
    "sort": {
        "Group Count": "measured",
        "Sort Methods Used": "measured",
        "Sort Space Memory": "scope:space",
        "Sort Space Disk": "scope:space",
    },
    "space": {
        "Average Sort Space Used": "measured",
        "Peak Sort Space Used": "measured",
    },
}
