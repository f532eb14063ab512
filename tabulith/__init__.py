"""tabulith: a Spark-native engine for checking citations against tabulated sources."""
