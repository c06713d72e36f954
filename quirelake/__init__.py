"""quirelake: Spark-native page-layout analytics and corpus preparation."""
