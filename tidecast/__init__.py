"""Multi-horizon analysis and forecasting of many related time series on Spark."""
