"""notewell: retrieval, sync and corpus analytics over note collections, written for Spark."""
