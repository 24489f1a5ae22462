"""vacantia: a Spark-native engine for job-market analytics and corpus preparation."""
