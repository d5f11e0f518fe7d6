from riskfold.sources.tables import table, register_views, TABLES
from riskfold.sources.infos import Catalog, ColumnInfo, read_infos, check_schema
from riskfold.sources.cohorts import (order_cohort, order_split, text_cohort, vector_cohort,
                                      ORDER_CATALOG, TEXT_CATALOG, vector_catalog, get_dataset,
                                      register_dataset)
from riskfold.sources.csv import read_table, read_any, nan_to_null

__all__ = ["table", "register_views", "TABLES", "Catalog", "ColumnInfo", "read_infos",
           "check_schema", "order_cohort", "order_split", "text_cohort", "vector_cohort",
           "ORDER_CATALOG", "TEXT_CATALOG", "vector_catalog", "get_dataset", "register_dataset",
           "read_table", "read_any", "nan_to_null"]
