"""Plans: adapters of star-schema tables to the engine, the query catalogue, and the build pipeline."""
