"""lumenark: statistics, machine learning and corpus preparation as DataFrame-in, DataFrame-out operators on Spark."""
