"""sessionloom.sources"""
