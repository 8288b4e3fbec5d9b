"""The given tables seen as billing data, and every operator as a query over them."""
