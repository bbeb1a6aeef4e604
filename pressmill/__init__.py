"""pressmill: news-feed analytics and corpus preparation as PySpark DataFrame programs."""
