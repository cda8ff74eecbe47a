"""DataFrame -> DataFrame operators over blocks, translations, jobs and pixels."""
