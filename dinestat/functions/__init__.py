"""Column builders: Spark expressions with no table behind them."""
