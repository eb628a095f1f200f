"""kartlens: basket and repurchase analytics on Spark DataFrames.

Load the six tables (``sources``), then call the steps in ``operators``:
repurchase cycle, order size, co-purchase pairs and shares, the final
extract and the dashboard data; ``plans`` registers them as queries and
materializes the metric tables; ``streaming`` loads CSV files as they arrive.
"""
