"""Flags and labels that are the same in every row prove nothing; the SQL of all queries is looked at on a larger table."""

import pandas as pd

from tests.oracle import connection
from tidemark.plans import registry

#: What these tables don't hold: no document has all prefixes of a query, and all names are of one account.
CONSTANT = {("prefix_match", "all_of"), ("account_naming", "account"), ("queue_order", "o_orderpriority"), ("vector_load", "pack")}


def test_every_flag_and_label_takes_more_than_one_value():
    duck, same = connection("/root/testdata/sf0.01"), set()
    for name, sql in registry.oracle_sql().items():
        rows = duck.sql(sql).df()
        for column in rows.columns if len(rows) > 5 else ():
            values = rows[column].dropna()
            if len(values) and values.map(lambda x: isinstance(x, (bool, str))).all() and pd.Series(values).nunique() < 2 and len(values) == len(rows):
                same.add((name, column))
    assert same <= CONSTANT
