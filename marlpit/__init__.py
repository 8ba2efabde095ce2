"""A Spark-native SQL analytics engine with a small dynamic-SQL flavoured function library."""
